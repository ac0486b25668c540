"""Decoders: one text column ``line`` to the columns of an event.

Each family is a predicate and a projection, so a mixed source is one pass: the first family that recognises a line
projects it, what nobody recognises stays a log message.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import netaddr
from vigilframe.functions.text import redact_text
from vigilframe.functions.times import parse_micros

ACCESS = (
    r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([A-Z]{3,10}) (\S+)(?: (HTTP/[\d.]+))?" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?'
)
SYSLOG_BSD = r"^(?:<(\d{1,3})>)?([A-Z][a-z]{2}\s+\d{1,2}\s\d{2}:\d{2}:\d{2}(?:\.\d+)?)\s+(\S+)\s+([^\s\[:]+)(?:\[(\d+)\])?:\s?(.*)$"
SYSLOG_IETF = r"^<(\d{1,3})>1\s+(\S+)\s+(\S+)\s+(\S+)\s+(\S+)\s+\S+\s+(?:-|(?:\[.*?\])+)\s?(.*)$"
SYSLOG_ISO = r"^()(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?)\s+(\S+)\s+([^\s\[:]+)(?:\[(\d+)\])?:\s?(.*)$"
VPC_FLOW = (
    r"^(\d+) (\d{12}|-) (eni-\w+|-) (\S+) (\S+) (\d+|-) (\d+|-) (\d+|-) (\d+|-) (\d+|-) (\d+) (\d+) (ACCEPT|REJECT|-) (OK|NODATA|SKIPDATA)$"
)
PROTOCOL_NAMES = {"1": "icmp", "6": "tcp", "17": "udp", "58": "icmpv6"}
FAMILIES = ["cloudtrail", "k8s", "ecs", "flow-json", "vpc-flow", "access", "syslog", "text"]
CLOUDTRAIL = (
    "eventID string, eventTime string, eventName string, eventSource string, awsRegion string, sourceIPAddress string, "
    "userAgent string, errorCode string, errorMessage string, requestID string, recipientAccountId string, readOnly boolean, "
    "userIdentity struct<type:string,arn:string,userName:string,principalId:string,accountId:string,accessKeyId:string,invokedBy:string>, "
    "requestParameters struct<bucketName:string,key:string,prefix:string,roleName:string,roleArn:string,groupName:string,userName:string,"
    "policyArn:string,instanceId:string,functionName:string>, "
    "responseElements struct<ConsoleLogin:string>, additionalEventData struct<bytesTransferredOut:bigint,bytesTransferredIn:bigint,MFAUsed:string>"
)
K8S = (
    "kind string, auditID string, verb string, requestURI string, requestReceivedTimestamp string, stageTimestamp string, level string, "
    "stage string, userAgent string, sourceIPs array<string>, user struct<username:string,groups:array<string>>, "
    "objectRef struct<resource:string,namespace:string,name:string,subresource:string,apiGroup:string>, "
    "responseStatus struct<code:int>, annotations map<string,string>"
)
ECS = (
    "`@timestamp` string, message string, event struct<category:string,type:string,action:string,outcome:string,severity:string,dataset:string>, "
    "user struct<name:string,id:string>, host struct<name:string,hostname:string>, source struct<ip:string,port:int,bytes:bigint>, "
    "destination struct<ip:string,port:int,bytes:bigint>, network struct<transport:string>, process struct<name:string,executable:string,"
    "command_line:string,pid:int>, file struct<path:string,name:string>, dns struct<question:struct<name:string>>, url struct<full:string,"
    "original:string>, http struct<request:struct<method:string>,response:struct<status_code:int>>, rule struct<name:string>"
)
FLOW = (
    "timestamp string, ts string, src_ip string, source_ip string, src string, dst_ip string, dest_ip string, destination_ip string, dst string, "
    "src_port int, dst_port int, dest_port int, protocol string, proto string, bytes_in bigint, bytes_out bigint, bytes bigint, packets bigint, "
    "decision string, action string, verdict string"
)
# API names with a meaning of their own.
IAM_GRANTS = ["AttachUserPolicy", "AttachRolePolicy", "AttachGroupPolicy", "PutUserPolicy", "PutRolePolicy", "PutGroupPolicy"]
IAM_REVOKES = ["DetachUserPolicy", "DetachRolePolicy", "DetachGroupPolicy", "DeleteUserPolicy", "DeleteRolePolicy", "DeleteGroupPolicy"]
IAM_CREDENTIALS = ["CreateAccessKey", "CreateLoginProfile", "UpdateLoginProfile"]
REFUSALS = ["deny", "denied", "reject", "rejected", "block", "blocked", "drop", "dropped", "failure", "fail", "failed"]


def _record(
    us: Column, event_type: Column, actor: Column, target: Column, outcome: Column, action: Column, severity: Column,
    message: Column, **attrs: Column,
) -> Column:
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v.cast("string"))]
    meta = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != "")) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(
        us.alias("us"), event_type.alias("event_type"), actor.alias("actor_id"), target.alias("target_id"),
        outcome.alias("outcome"), action.alias("action"), severity.alias("severity"), message.alias("message"), meta.alias("attrs"),
    )


def _group(pattern: str, i: int, column: str = "line") -> Column:
    return F.nullif(F.regexp_extract(F.col(column), pattern, i), F.lit(""))


def access_log(server: str = "web", reference_us: Column | None = None) -> tuple[Column, Column]:
    """(recognised, record) for the common and combined web-server formats."""
    line = F.col("line")
    g = [None] + [F.col(f"_a{i}") for i in range(1, 11)]
    status = g[7].cast("int")
    rec = _record(
        parse_micros(g[3], reference_us), F.lit("http.request"), F.concat(F.lit("ip:"), g[1]),
        F.concat(F.lit(f"url:http://{server}"), g[5]), F.when(status >= 400, "failure").otherwise("success"), F.lower(g[4]),
        F.when(status.isin(401, 403), "LOW").otherwise("INFO"), F.concat_ws(" ", g[4], g[5], F.lit("->"), g[7]),
        src_ip=g[1], user=F.nullif(g[2], F.lit("-")), method=g[4], path=g[5], protocol=g[6], status=status,
        bytes=F.nullif(g[8], F.lit("-")), referrer=F.nullif(g[9], F.lit("-")), user_agent=g[10],
    )
    return line.rlike(ACCESS), rec


def syslog(reference_us: Column | None = None) -> tuple[Column, Column]:
    """Three header forms; sshd, sudo, su, logind, cron and kernel firewall messages, the rest as log messages."""
    line = F.col("line")

    ts, host, prog, pid, msg = (F.col(f"_s{i}") for i in range(2, 7))
    program = F.lower(prog)

    def m(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(msg, pattern, i), F.lit(""))

    accept = r"^Accepted (\S+) for (\S+) from (\S+) port (\d+)"
    fail = r"^Failed (\S+) for (?:invalid user )?(\S+) from (\S+) port (\d+)"
    invalid = r"^Invalid user (\S*) from (\S+)"
    left = r"^Disconnected from (?:user )?(\S+) (\S+) port (\d+)"
    closed = r"session closed for user (\S+)"
    sudo = r"^\s*(\S+) : (?:TTY=(\S+) ; )?PWD=(\S+) ; USER=(\S+) ;(?: COMMAND=(.+))?$"
    sudo_fail = r"^\s*(\S+) : (\d+) incorrect password attempts?"
    su_ok = r"^\(to (\S+)\) (\S+) on"
    su_done = r"^Successful su for (\S+) by (\S+)"
    su_fail = r"^FAILED su for (\S+) by (\S+)"
    new, gone = r"^New session (\S+) of user (\S+)", r"^Removed session (\S+)"
    cron = r"^\(([^)]+)\) CMD \((.*)\)\s*$"
    fw = r"IN=(\S*) OUT=(\S*).*?SRC=(\S+) DST=(\S+).*?PROTO=(\S+)(?:.*?SPT=(\d+))?(?:.*?DPT=(\d+))?"
    ssh = program.startswith("sshd")
    blocked = F.upper(msg).rlike("BLOCK|DROP|DENY|REJECT")
    us = parse_micros(ts, reference_us)
    target = F.concat(F.lit("host:"), F.lower(host))

    def user(name: Column) -> Column:
        return F.concat(F.lit("user:"), F.lower(name))

    base = {"program": prog, "program_pid": F.nullif(pid, F.lit("-"))}

    def ev(kind, actor, outcome, action, severity="INFO", to=target, **attrs):
        return _record(us, F.lit(kind), actor, to, F.lit(outcome).cast("string") if not isinstance(outcome, Column) else outcome,
                       F.lit(action), F.lit(severity), msg, **base, **attrs)

    none = F.lit(None).cast("string")
    pad = dict.fromkeys(())
    rec = (
        F.when(ssh & msg.rlike(accept), ev("auth.login", user(m(accept, 2)), "success", "ssh-login", src_ip=m(accept, 3), src_port=m(accept, 4), method=m(accept, 1), **pad))
        .when(ssh & msg.rlike(fail), ev("auth.failure", user(m(fail, 2)), "failure", "ssh-login", "LOW", src_ip=m(fail, 3), src_port=m(fail, 4), method=m(fail, 1)))
        .when(ssh & msg.rlike(invalid), ev("auth.failure", user(F.coalesce(m(invalid, 1), F.lit("unknown"))), "failure", "ssh-invalid-user", "LOW", src_ip=m(invalid, 2)))
        .when(ssh & msg.rlike(left), ev("auth.logout", user(m(left, 1)), none, "ssh-disconnect", src_ip=m(left, 2)))
        .when(ssh & msg.rlike(closed), ev("auth.logout", user(m(closed, 1)), none, "session-closed"))
        .when((program == "sudo") & msg.rlike(sudo_fail), ev("auth.failure", user(m(sudo_fail, 1)), "failure", "sudo", "MEDIUM", attempts=m(sudo_fail, 2)))
        .when((program == "sudo") & msg.rlike(sudo), ev("auth.privilege", user(m(sudo, 1)), "success", "sudo", as_user=m(sudo, 4), command=F.trim(m(sudo, 5)), pwd=m(sudo, 3), tty=m(sudo, 2)))
        .when((program == "su") & msg.rlike(su_fail), ev("auth.failure", user(m(su_fail, 2)), "failure", "su", "MEDIUM", as_user=m(su_fail, 1)))
        .when((program == "su") & (msg.rlike(su_ok) | msg.rlike(su_done)), ev("auth.privilege", user(F.coalesce(m(su_ok, 2), m(su_done, 2))), "success", "su", as_user=F.coalesce(m(su_ok, 1), m(su_done, 1))))
        .when((program == "systemd-logind") & msg.rlike(new), ev("auth.login", user(m(new, 2)), "success", "session-new", session_id=m(new, 1)))
        .when((program == "systemd-logind") & msg.rlike(gone), ev("auth.logout", none, none, "session-removed", session_id=m(gone, 1)))
        .when(program.isin("cron", "crond") & msg.rlike(cron), ev("process.start", user(m(cron, 1)), none, "cron", to=none, image=F.split(F.trim(m(cron, 2)), r"\s+")[0], command_line=F.trim(m(cron, 2)), scheduler=F.lit("cron")))
        .when((program == "kernel") & msg.rlike(fw), ev("network.connection", F.concat(F.lit("ip:"), m(fw, 3)), F.when(blocked, "failure").otherwise("success"), "firewall", to=F.concat(F.lit("ip:"), m(fw, 4)), src_ip=m(fw, 3), dst_ip=m(fw, 4), protocol=F.lower(m(fw, 5)), src_port=m(fw, 6), dst_port=m(fw, 7), blocked=blocked))
        .otherwise(ev("log.message", none, none, "log"))
    )
    return line.rlike(SYSLOG_IETF) | line.rlike(SYSLOG_ISO) | line.rlike(SYSLOG_BSD), rec


def cloudtrail() -> tuple[Column, Column]:
    j = F.col("_jc")
    ident, params = j["userIdentity"], j["requestParameters"]
    arn = F.coalesce(ident["arn"], F.lit(""))
    role = F.nullif(F.regexp_extract(arn, r"^arn:[^:]*:sts::(\d+):assumed-role/([^/]+)/(.+)$", 2), F.lit(""))
    session = F.regexp_extract(arn, r"^arn:[^:]*:sts::\d+:assumed-role/[^/]+/(.+)$", 1)
    account = F.regexp_extract(arn, r"^arn:[^:]*:sts::(\d+):", 1)
    user = F.coalesce(ident["userName"], ident["invokedBy"], ident["principalId"],
                      F.when(F.contains(arn, F.lit("/")), F.substring_index(arn, "/", -1)), ident["type"], F.lit("unknown"))
    actor = F.when(role.isNotNull(), F.concat(F.lit("role:arn:aws:iam::"), account, F.lit(":role/"), F.lower(role))).otherwise(
        F.concat(F.lit("identity:"), F.lower(F.coalesce(F.nullif(arn, F.lit("")), user))))
    name, service = j["eventName"], F.substring_index(F.coalesce(j["eventSource"], F.lit("aws")), ".", 1)
    failed = F.coalesce(j["errorCode"], F.lit("")) != ""
    main = F.coalesce(params["bucketName"], params["roleName"], params["groupName"], params["instanceId"], params["functionName"],
                      params["userName"], params["policyArn"], service)
    resource = F.when(params["bucketName"].isNotNull(), F.concat(F.lit("cloud_resource:aws/s3/"), params["bucketName"])).otherwise(
        F.concat(F.lit("cloud_resource:aws/"), service, F.lit("/"), main))
    principal = F.coalesce(params["userName"], params["roleName"], params["groupName"])
    granting = name.isin(IAM_GRANTS + IAM_REVOKES)
    kind = (
        F.when(name == "ConsoleLogin", F.when(failed | (j["responseElements"]["ConsoleLogin"] == "Failure"), "auth.failure").otherwise("auth.login"))
        .when(name.isin(IAM_GRANTS), "iam.permission.grant").when(name.isin(IAM_REVOKES), "iam.permission.revoke")
        .when(name == "AddUserToGroup", "iam.group.add").when(name == "RemoveUserFromGroup", "iam.group.remove")
        .when(name.isin(IAM_CREDENTIALS), "iam.credential.create").when(name == "CreateUser", "iam.user.create").otherwise("cloud.api")
    )
    target = (
        F.when(name == "ConsoleLogin", F.concat(F.lit("cloud_resource:aws-console/"), j["recipientAccountId"]))
        .when(granting & principal.isNotNull(), F.concat(F.lit("identity:"), F.lower(principal)))
        .when(name.isin("AddUserToGroup", "RemoveUserFromGroup"), F.concat(F.lit("identity:"), F.lower(params["userName"])))
        .when(name.isin(IAM_CREDENTIALS), F.concat(F.lit("identity:"), F.lower(F.coalesce(params["userName"], user))))
        .when(name == "CreateUser", F.concat(F.lit("identity:"), F.lower(F.coalesce(params["userName"], F.lit("unknown")))))
        .when(name == "AssumeRole", F.concat(F.lit("role:"), F.lower(params["roleArn"]))).otherwise(resource)
    )
    address = F.when(netaddr.ip_scope(j["sourceIPAddress"]).isNotNull(), j["sourceIPAddress"])
    where = F.when(params["bucketName"].isNotNull(), F.concat(F.lit(" on "), params["bucketName"], F.coalesce(F.concat(F.lit("/"), params["key"]), F.lit(""))))
    message = F.concat(name, F.lit(" via "), j["eventSource"], F.when(failed, F.concat(F.lit(" failed: "), j["errorCode"])).otherwise(""), F.coalesce(where, F.lit("")))
    rec = _record(
        parse_micros(j["eventTime"]), kind, actor, target, F.when(failed, "failure").otherwise("success"), name,
        F.when(failed, "LOW").otherwise("INFO"), message, api=name, event_source=j["eventSource"], region=j["awsRegion"], src_ip=address,
        source_service=F.when(address.isNull(), j["sourceIPAddress"]), error_code=j["errorCode"],
        error_message=redact_text(j["errorMessage"]), request_id=j["requestID"], bucket=params["bucketName"], object_key=params["key"],
        bytes_out=j["additionalEventData"]["bytesTransferredOut"], bytes_in=j["additionalEventData"]["bytesTransferredIn"],
        identity_type=ident["type"], role_session=session, mfa=j["additionalEventData"]["MFAUsed"],
        access_key=F.when(ident["accessKeyId"].isNotNull(), F.concat(F.substring(ident["accessKeyId"], 1, 3), F.lit("****"), F.right(ident["accessKeyId"], F.lit(4)))),
    )
    return j["eventName"].isNotNull() & j["eventSource"].isNotNull(), rec


def k8s_audit() -> tuple[Column, Column]:
    j = F.col("_jk")
    ref = j["objectRef"]
    user, verb = F.coalesce(j["user"]["username"], F.lit("unknown")), F.coalesce(j["verb"], F.lit("unknown"))
    resource = F.coalesce(ref["resource"], F.substring_index(F.coalesce(j["requestURI"], F.lit("api")), "?", 1))
    code, decision = j["responseStatus"]["code"], j["annotations"]["authorization.k8s.io/decision"]
    failed = F.coalesce(code >= 400, F.lit(False)) | F.coalesce(decision == "forbid", F.lit(False))
    path = F.concat_ws("/", F.lit("k8s"), F.coalesce(ref["namespace"], F.lit("cluster")), resource, ref["name"])
    shown = F.concat_ws("/", resource, ref["name"])
    message = F.concat(verb, F.lit(" "), shown, F.lit(" in "), F.coalesce(ref["namespace"], F.lit("cluster scope")),
                       F.coalesce(F.concat(F.lit(" -> "), code.cast("string")), F.lit("")))
    rec = _record(
        parse_micros(F.coalesce(j["requestReceivedTimestamp"], j["stageTimestamp"])), F.lit("cloud.api"),
        F.concat(F.lit("identity:k8s|"), F.lower(user)), F.concat(F.lit("cloud_resource:"), path),
        F.when(failed, "failure").when(code.isNotNull(), "success"), verb, F.when(failed, "LOW").otherwise("INFO"), message,
        verb=verb, k8s_resource=resource, namespace=ref["namespace"], name=ref["name"], status_code=code, audit_id=j["auditID"],
        src_ip=F.get(j["sourceIPs"], F.lit(0)), user_agent=j["userAgent"], stage=j["stage"], decision=decision,
    )
    return (j["kind"] == "Event") & (j["auditID"].isNotNull() | (j["verb"].isNotNull() & ref.isNotNull())), rec


def ecs() -> tuple[Column, Column]:
    j = F.col("_je")
    cat, kind, action = F.lower(F.coalesce(j["event"]["category"], F.lit(""))), F.lower(F.coalesce(j["event"]["type"], F.lit(""))), F.coalesce(j["event"]["action"], F.lit(""))

    def has(text: Column, word: str) -> Column:
        # a category is a string or the text of a JSON array of strings
        return text.rlike(rf'(^|["\[, ]){word}($|["\], ])')

    host = F.coalesce(j["host"]["name"], j["host"]["hostname"])
    query, url = j["dns"]["question"]["name"], F.coalesce(j["url"]["full"], j["url"]["original"])
    outcome = j["event"]["outcome"]
    slug = F.regexp_replace(F.lower(action), r"[^a-z0-9]+", "_")
    auth, proc, file, net = has(cat, "authentication"), has(cat, "process"), has(cat, "file"), has(cat, "network")
    web = has(cat, "web") | url.isNotNull()
    etype = (
        F.when(auth, F.when(F.lower(outcome) == "failure", "auth.failure").when(has(kind, "end"), "auth.logout").otherwise("auth.login"))
        .when(proc, F.when(has(kind, "end"), "process.end").otherwise("process.start"))
        .when(file, F.when(has(kind, "creation"), "file.create").when(has(kind, "deletion"), "file.delete").when(has(kind, "change"), "file.modify")
              .when(has(kind, "access"), "file.read").otherwise("file.modify"))
        .when(query.isNotNull(), "dns.query").when(web, "http.request").when(net, "network.connection")
        .when(has(cat, "intrusion_detection") | has(cat, "malware") | j["rule"]["name"].isNotNull(), "alert")
        .when(action != "", F.concat(F.lit("log."), slug)).otherwise("log.message")
    )
    user = F.coalesce(j["user"]["name"], j["user"]["id"])
    src, dst = j["source"]["ip"], j["destination"]["ip"]

    def typed(prefix: str, value: Column, fold: bool = True) -> Column:
        return F.concat(F.lit(prefix + ":"), F.lower(value) if fold else value)

    actor = (
        F.when(etype == "http.request", F.coalesce(typed("user", user), typed("ip", src)))
        .when(etype == "network.connection", F.coalesce(typed("host", host), typed("ip", src))).otherwise(typed("user", user))
    )
    target = (
        F.when(etype.startswith("file."), typed("file", F.coalesce(j["file"]["path"], j["file"]["name"]), False))
        .when(etype == "dns.query", typed("domain", query)).when(etype == "http.request", typed("url", url, False))
        .when(etype == "network.connection", typed("ip", dst)).when(etype.startswith("process."), F.lit(None).cast("string"))
        .otherwise(typed("host", host))
    )
    rec = _record(
        parse_micros(j["@timestamp"]), etype, actor, target, outcome, F.nullif(action, F.lit("")), F.upper(F.coalesce(j["event"]["severity"], F.lit("INFO"))),
        j["message"], src_ip=src, dst_ip=dst, dst_port=j["destination"]["port"], src_port=j["source"]["port"], protocol=j["network"]["transport"],
        bytes_out=j["source"]["bytes"], bytes_in=j["destination"]["bytes"], pid=j["process"]["pid"],
        image=F.coalesce(j["process"]["executable"], F.when(proc, j["process"]["name"])), command_line=j["process"]["command_line"],
        method=j["http"]["request"]["method"], status=j["http"]["response"]["status_code"], rule=j["rule"]["name"], dataset=j["event"]["dataset"],
    )
    return j["@timestamp"].isNotNull() & (j["event"].isNotNull() | j["message"].isNotNull()), rec


def flow_json() -> tuple[Column, Column]:
    j = F.col("_jf")
    src, dst = F.coalesce(j["src_ip"], j["source_ip"], j["src"]), F.coalesce(j["dst_ip"], j["dest_ip"], j["destination_ip"], j["dst"])
    port, proto = F.coalesce(j["dst_port"], j["dest_port"]), F.lower(F.coalesce(j["protocol"], j["proto"]))
    decision = F.coalesce(j["decision"], j["action"], j["verdict"])
    blocked = F.coalesce(F.lower(decision).isin(REFUSALS), F.lit(False))
    total = F.coalesce(j["bytes"], F.coalesce(j["bytes_in"], F.lit(0)) + F.coalesce(j["bytes_out"], F.lit(0)))
    message = F.concat(src, F.lit(" -> "), dst, F.coalesce(F.concat(F.lit(":"), port.cast("string")), F.lit("")),
                       F.coalesce(F.concat(F.lit("/"), proto), F.lit("")), F.coalesce(F.concat(F.lit(" "), decision), F.lit("")))
    flowish = F.coalesce(j["bytes"], j["bytes_in"], j["bytes_out"], j["packets"], port.cast("bigint")).isNotNull() | proto.isNotNull() | decision.isNotNull()
    rec = _record(
        parse_micros(F.coalesce(j["timestamp"], j["ts"])), F.lit("network.flow"), F.concat(F.lit("ip:"), src), F.concat(F.lit("ip:"), dst),
        F.when(blocked, "failure").when(decision.isNotNull(), "success"), F.coalesce(F.lower(decision), F.lit("flow")),
        F.when(blocked, "LOW").otherwise("INFO"), message, src_ip=src, dst_ip=dst, src_port=j["src_port"], dst_port=port, protocol=proto,
        bytes_in=j["bytes_in"], bytes_out=j["bytes_out"], bytes=total, packets=j["packets"], blocked=F.when(blocked, F.lit(True)),
    )
    ok = (netaddr.ip_scope(src).isNotNull() & netaddr.ip_scope(dst).isNotNull() & flowish)
    return F.coalesce(ok, F.lit(False)), rec


def vpc_flow() -> tuple[Column, Column]:
    def n(i: int) -> Column:
        return F.nullif(F.col(f"_v{i}"), F.lit("-"))

    proto = n(8)
    for number, name in PROTOCOL_NAMES.items():
        proto = F.when(n(8) == number, name).otherwise(proto)
    rejected, data = n(13) == "REJECT", n(14) == "OK"
    message = F.concat(n(4), F.lit(":"), n(6), F.lit(" -> "), n(5), F.lit(":"), n(7), F.lit(" "), proto, F.lit(" "), n(13))
    rec = _record(
        parse_micros(n(11)), F.when(data, "network.flow").otherwise("log.flow_nodata"), F.when(data, F.concat(F.lit("ip:"), n(4))),
        F.when(data, F.concat(F.lit("ip:"), n(5))), F.when(data, F.when(rejected, "failure").otherwise("success")), F.lower(n(13)),
        F.when(rejected, "LOW").otherwise("INFO"), message, src_ip=n(4), dst_ip=n(5), src_port=n(6), dst_port=n(7), protocol=proto,
        packets=n(9), bytes=n(10), account=n(2), interface=n(3), blocked=F.when(rejected, F.lit(True)),
    )
    return F.col("line").rlike(VPC_FLOW), rec


def _stage(family: str) -> dict[str, Column]:
    """What a family takes from the line, each extracted once into a column of its own."""
    if family == "access":
        return {f"_a{i}": _group(ACCESS, i) for i in range(1, 11)}
    if family == "syslog":
        heads = {f"_s{i}": F.coalesce(*[_group(p, i) for p in (SYSLOG_IETF, SYSLOG_ISO, SYSLOG_BSD)]) for i in range(2, 7)}
        return heads | {"_s6": F.coalesce(heads["_s6"], F.lit(""))}
    if family == "vpc-flow":
        return {f"_v{i}": _group(VPC_FLOW, i) for i in range(1, 15)}
    name, schema = {"cloudtrail": ("_jc", CLOUDTRAIL), "k8s": ("_jk", K8S), "ecs": ("_je", ECS), "flow-json": ("_jf", FLOW)}[family]
    return {name: F.from_json("line", schema)}


def decode(lines: DataFrame, family: str, reference_us: Column | None = None, server: str = "web") -> DataFrame:
    """``lines(line, ...)`` of one family: decoded columns added; ``error`` set where the family does not fit."""
    ok, rec = _family(family, reference_us, server)
    ok = F.coalesce(ok, F.lit(False))
    out = lines.withColumns(_stage(family)).withColumn("rec", F.when(ok, rec))
    return out.select(*lines.columns, "rec.*", F.when(F.col("rec").isNull(), F.lit(f"not in {family} format")).alias("error"))


def _family(name: str, reference_us: Column | None, server: str) -> tuple[Column, Column]:
    if name == "access":
        return access_log(server, reference_us)
    if name == "syslog":
        return syslog(reference_us)
    return {"cloudtrail": cloudtrail, "k8s": k8s_audit, "ecs": ecs, "flow-json": flow_json, "vpc-flow": vpc_flow}[name]()


def decode_mixed(lines: DataFrame, reference_us: Column | None = None, server: str = "web") -> DataFrame:
    """Each line by the first family that recognises it, in one pass; ``family`` says which."""
    line = F.trim(F.col("line"))
    is_json = line.startswith("{")
    tests, recs = {}, {}
    for name in FAMILIES[:-1]:
        ok, rec = _family(name, reference_us, server)
        json_like = name in ("cloudtrail", "k8s", "ecs", "flow-json")
        tests[name] = F.coalesce(ok, F.lit(False)) & (is_json if json_like else ~is_json)
        recs[name] = rec
    family = F.lit("text")
    for name in reversed(FAMILIES[:-1]):
        family = F.when(tests[name], name).otherwise(family)
    none = F.lit(None).cast("string")
    text = _record(F.lit(None).cast("long"), F.lit("log.message"), none, none, none, F.lit("log"), F.lit("INFO"), F.col("line"))
    rec = text
    for name in reversed(FAMILIES[:-1]):
        rec = F.when(F.col("family") == name, recs[name]).otherwise(rec)
    staged = {k: v for name in FAMILIES[:-1] for k, v in _stage(name).items()}
    out = lines.where(line != "").withColumns(staged).withColumn("family", family)
    return out.withColumn("rec", rec).select(*lines.columns, "family", "rec.*")
