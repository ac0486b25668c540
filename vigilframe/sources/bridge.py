"""Model tables derived from the star-schema test tables.

Each model table is a list of named expressions valid in Spark SQL and in ANSI engines alike; only JSON access and
microsecond arithmetic differ, so those are placeholders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SPARK = {"k": "CAST(get_json_object(props, '$.k') AS INT)", "us": "unix_micros(CAST({c} AS TIMESTAMP))"}
ANSI = {"k": "CAST(json_extract_string(props, '$.k') AS INT)", "us": "epoch_us({c})"}

EVENT_COLUMNS = {
    "id": "concat('event:', lpad(CAST(event_id AS STRING), 12, '0'))",
    "us": "{us_ts}",
    "event_type": "CASE event_type WHEN 'signup' THEN 'auth.login' WHEN 'error' THEN 'auth.failure' "
    "WHEN 'click' THEN 'http.request' WHEN 'view' THEN 'file.read' ELSE 'network.flow' END",
    "category": "CASE event_type WHEN 'signup' THEN 'auth' WHEN 'error' THEN 'auth' WHEN 'click' THEN 'http' "
    "WHEN 'view' THEN 'file' ELSE 'network' END",
    "action": "event_type",
    "outcome": "CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END",
    "actor_id": "concat('user:u', CAST(user_id AS STRING))",
    "target_id": "concat('host:h', CAST(k % 20 AS STRING))",
    "src_ip": "CASE WHEN k < 80 THEN concat('10.10.', CAST(k % 4 AS STRING), '.', CAST(user_id % 250 AS STRING)) "
    "ELSE concat('198.51.100.', CAST(k - 80 AS STRING)) END",
    "severity": "CASE WHEN event_type <> 'error' THEN 'INFO' WHEN value >= 100 THEN 'HIGH' "
    "WHEN value >= 40 THEN 'MEDIUM' ELSE 'LOW' END",
    "severity_rank": "CASE WHEN event_type <> 'error' THEN 0 WHEN value >= 100 THEN 3 WHEN value >= 40 THEN 2 ELSE 1 END",
    "confidence": "CAST(round(0.5 + (k % 50) / 100.0, 4) AS DOUBLE)",
    "bytes": "CAST(floor(value * 100000) AS BIGINT)",
    "source": "concat('src', CAST(k % 5 AS STRING))",
    "parser": "CASE WHEN k % 2 = 0 THEN 'json' ELSE 'text' END",
    "path": "concat('/', event_type, '/', CAST(k AS STRING), '.', CASE WHEN k % 7 = 0 THEN 'zip' ELSE 'html' END)",
    "status": "CASE WHEN event_type = 'error' THEN 500 WHEN k % 10 < 4 THEN 404 ELSE 200 END",
    "message": "concat('User ', CAST(user_id AS STRING), ' ', event_type, ' on H', CAST(k % 20 AS STRING))",
    "k": "k",
}


def _fill(expr: str, dialect: dict[str, str]) -> str:
    text = expr.replace("{k}", dialect["k"])
    for name in ("ts", "o_orderdate", "l_shipdate"):
        text = text.replace("{us_" + name + "}", dialect["us"].replace("{c}", name))
    return text


# name -> (input tables, SQL text); `{name}` in the text stands for a table
MODEL_SQL: dict[str, tuple[list[str], str]] = {
    "ev": (["events"], "SELECT " + ", ".join(f"{e} AS {n}" for n, e in EVENT_COLUMNS.items()) + " FROM (SELECT *, {k} AS k FROM {events}) e"),
    # role-tagged involvement of objects in events
    "eo": (
        ["ev"],
        "SELECT id AS event_id, actor_id AS object_id, 'actor' AS role, us FROM {ev} UNION ALL "
        "SELECT id, target_id, 'target', us FROM {ev} UNION ALL "
        "SELECT id, concat('ip:', src_ip), 'src_ip', us FROM {ev}",
    ),
    # an incident gathers the failures of one user against one host
    "inc": (
        ["ev"],
        "SELECT concat('incident:', substr(actor_id, 6), '-', substr(target_id, 6)) AS incident_id, id AS event_id, us "
        "FROM {ev} WHERE event_type = 'auth.failure'",
    ),
    "obj": (
        ["customer", "supplier", "nation", "region", "part"],
        "SELECT id, type, name, tag, criticality, cvss, flags LIKE '%disabled%' AS disabled, "
        "flags LIKE '%privileged%' AS privileged, flags LIKE '%wildcard%' AS wildcard, flags LIKE '%nomfa%' AS nomfa, "
        "flags LIKE '%hasmfa%' AS mfa, flags LIKE '%external%' AS external, flags LIKE '%internet%' AS internet, "
        "flags LIKE '%workstation%' AS workstation FROM ("
        "SELECT concat('user:c', CAST(c_custkey AS STRING)) AS id, 'user' AS type, c_name AS name, "
        "lower(c_mktsegment) AS tag, CAST(NULL AS STRING) AS criticality, CAST(NULL AS DOUBLE) AS cvss, "
        "concat(CASE WHEN c_acctbal < 0 THEN 'disabled ' ELSE '' END, "
        "CASE WHEN c_acctbal > 9500 THEN 'privileged ' ELSE '' END, "
        "CASE c_mktsegment WHEN 'MACHINERY' THEN 'nomfa' WHEN 'BUILDING' THEN 'hasmfa' ELSE '' END) AS flags "
        "FROM {customer} "
        "UNION ALL SELECT concat('host:s', CAST(s_suppkey AS STRING)), 'host', s_name, "
        "CASE WHEN s_acctbal < 1000 THEN 'workstation' ELSE 'server' END, "
        "CASE WHEN s_acctbal >= 8000 THEN 'critical' WHEN s_acctbal >= 5000 THEN 'high' "
        "WHEN s_acctbal >= 2000 THEN 'medium' ELSE 'low' END, CAST(NULL AS DOUBLE), "
        "CASE WHEN s_acctbal < 1000 THEN 'workstation' ELSE '' END FROM {supplier} "
        "UNION ALL SELECT concat('group:n', CAST(n_nationkey AS STRING)), 'group', n_name, 'group', "
        "CAST(NULL AS STRING), CAST(NULL AS DOUBLE), '' FROM {nation} "
        "UNION ALL SELECT concat('group:g', CAST(r_regionkey AS STRING)), 'group', r_name, 'group', "
        "CAST(NULL AS STRING), CAST(NULL AS DOUBLE), '' FROM {region} "
        "UNION ALL SELECT concat('network:n', CAST(n_nationkey AS STRING)), 'network', n_name, 'network', "
        "CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CASE WHEN n_regionkey = 0 THEN 'internet' ELSE '' END FROM {nation} "
        "UNION ALL SELECT concat('identity:i', CAST(n_nationkey AS STRING)), 'identity', concat('svc-', n_name), 'service', "
        "CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CASE WHEN n_regionkey < 2 THEN 'privileged' ELSE '' END FROM {nation} "
        "UNION ALL SELECT concat('role:r', CAST(r_regionkey AS STRING)), 'role', r_name, 'role', "
        "CAST(NULL AS STRING), CAST(NULL AS DOUBLE), '' FROM {region} "
        "UNION ALL SELECT concat('role:p', CAST(r_regionkey AS STRING)), 'role', concat('admin-', r_name), 'role', "
        "CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CASE r_regionkey WHEN 0 THEN 'privileged wildcard' "
        "WHEN 1 THEN 'privileged' ELSE '' END FROM {region} "
        "UNION ALL SELECT concat('organization:o', CAST(r_regionkey AS STRING)), 'organization', r_name, 'organization', "
        "CAST(NULL AS STRING), CAST(NULL AS DOUBLE), CASE WHEN r_regionkey = 4 THEN 'external' ELSE '' END FROM {region} "
        "UNION ALL SELECT concat('cloud_resource:c', CAST(r_regionkey AS STRING)), 'cloud_resource', r_name, 'cloud', "
        "'high', CAST(NULL AS DOUBLE), '' FROM {region} "
        "UNION ALL SELECT concat('secret:x', CAST(s_suppkey AS STRING)), 'secret', s_name, 'secret', "
        "CAST(NULL AS STRING), CAST(NULL AS DOUBLE), '' FROM {supplier} WHERE s_acctbal BETWEEN 6000 AND 7000 "
        "UNION ALL SELECT concat('service:p', CAST(p_partkey AS STRING)), 'service', p_name, lower(p_type), "
        "CASE p_type WHEN 'PROMO' THEN 'critical' WHEN 'LARGE' THEN 'high' WHEN 'MEDIUM' THEN 'medium' ELSE 'low' END, "
        "CAST(NULL AS DOUBLE), '' FROM {part} "
        "UNION ALL SELECT DISTINCT concat('vulnerability:v', CAST(p_size AS STRING), '-', lower(p_brand)), "
        "'vulnerability', concat('V', CAST(p_size AS STRING), ' ', p_brand), 'vulnerability', CAST(NULL AS STRING), "
        "p_size / CAST(5.0 AS DOUBLE), '' FROM {part} WHERE p_size >= 30) objects_with_flags",
    ),
    "rel": (
        ["customer", "supplier", "nation", "region", "orders", "lineitem", "part"],
        "SELECT concat('user:c', CAST(c_custkey AS STRING)) AS src, 'MEMBER_OF' AS type, "
        "concat('group:n', CAST(c_nationkey AS STRING)) AS dst, CAST(0.9 AS DOUBLE) AS conf, "
        "CAST(NULL AS BIGINT) AS first_us, CAST(NULL AS BIGINT) AS last_us, CAST(NULL AS BIGINT) AS to_us "
        "FROM {customer} "
        "UNION ALL SELECT concat('host:s', CAST(s_suppkey AS STRING)), 'MEMBER_OF', "
        "concat('network:n', CAST(s_nationkey AS STRING)), CAST(1.0 AS DOUBLE), NULL, NULL, NULL FROM {supplier} "
        "UNION ALL SELECT concat('group:n', CAST(n_nationkey AS STRING)), 'HAS_ROLE', "
        "concat('role:r', CAST(n_regionkey AS STRING)), CAST(0.8 AS DOUBLE), NULL, NULL, NULL FROM {nation} "
        "UNION ALL SELECT concat('group:n', CAST(n_nationkey AS STRING)), 'MEMBER_OF', "
        "concat('group:g', CAST(n_regionkey AS STRING)), CAST(0.9 AS DOUBLE), NULL, NULL, NULL FROM {nation} "
        "UNION ALL SELECT concat('group:g', CAST(r_regionkey AS STRING)), 'HAS_ROLE', "
        "concat('role:p', CAST(r_regionkey AS STRING)), CAST(0.9 AS DOUBLE), NULL, NULL, NULL FROM {region} "
        "UNION ALL SELECT concat('role:p', CAST(n_regionkey AS STRING)), 'ADMIN_OF', "
        "concat('host:s', CAST(max(s_suppkey) AS STRING)), CAST(0.9 AS DOUBLE), NULL, NULL, NULL "
        "FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_regionkey "
        "UNION ALL SELECT concat('user:c', CAST(c_custkey AS STRING)), 'HAS_IDENTITY', "
        "concat('identity:i', CAST(c_nationkey AS STRING)), CAST(0.8 AS DOUBLE), NULL, NULL, NULL "
        "FROM {customer} WHERE c_acctbal > 9000 "
        "UNION ALL SELECT concat('identity:i', CAST(s_nationkey AS STRING)), 'CAN_ACCESS', "
        "concat('host:s', CAST(max(s_suppkey) AS STRING)), CAST(0.8 AS DOUBLE), NULL, NULL, NULL "
        "FROM {supplier} GROUP BY s_nationkey "
        "UNION ALL SELECT concat('host:s', CAST(s_suppkey AS STRING)), 'USES', "
        "concat('identity:i', CAST(s_nationkey AS STRING)), CAST(0.7 AS DOUBLE), NULL, NULL, NULL "
        "FROM {supplier} WHERE s_acctbal > 5000 "
        "UNION ALL SELECT concat('host:s', CAST(s_suppkey AS STRING)), 'CONTAINS_SECRET', "
        "concat('secret:x', CAST(s_suppkey AS STRING)), CAST(0.9 AS DOUBLE), NULL, NULL, NULL "
        "FROM {supplier} WHERE s_acctbal BETWEEN 6000 AND 7000 "
        "UNION ALL SELECT concat('secret:x', CAST(s_suppkey AS STRING)), 'AUTHENTICATES_AS', "
        "concat('identity:i', CAST(s_nationkey AS STRING)), CAST(0.95 AS DOUBLE), NULL, NULL, NULL "
        "FROM {supplier} WHERE s_acctbal BETWEEN 6000 AND 7000 "
        "UNION ALL SELECT concat('organization:o', CAST(r_regionkey AS STRING)), 'TRUSTS', "
        "concat('organization:o', CAST((r_regionkey + 1) % 5 AS STRING)), CAST(0.7 AS DOUBLE), NULL, NULL, NULL FROM {region} "
        "UNION ALL SELECT concat('organization:o', CAST(r_regionkey AS STRING)), 'CONTAINS', "
        "concat('cloud_resource:c', CAST(r_regionkey AS STRING)), CAST(0.9 AS DOUBLE), NULL, NULL, NULL FROM {region} "
        "UNION ALL SELECT concat('cloud_resource:c', CAST(n_regionkey AS STRING)), 'CONTAINS', "
        "concat('host:s', CAST(s_suppkey AS STRING)), CAST(0.9 AS DOUBLE), NULL, NULL, NULL "
        "FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey WHERE s_acctbal >= 7000 "
        "UNION ALL SELECT concat('user:c', CAST(c_custkey AS STRING)), 'OWNS', "
        "concat('host:s', CAST(s_suppkey AS STRING)), CAST(0.6 AS DOUBLE), NULL, NULL, NULL "
        "FROM {customer} JOIN {supplier} ON s_suppkey = c_custkey AND s_acctbal < 1000 "
        "UNION ALL SELECT concat('role:r', CAST(n_regionkey AS STRING)), 'CAN_ACCESS', "
        "concat('host:s', CAST(min(s_suppkey) AS STRING)), CAST(0.9 AS DOUBLE), NULL, NULL, NULL "
        "FROM {nation} JOIN {supplier} ON s_nationkey = n_nationkey GROUP BY n_regionkey "
        "UNION ALL SELECT concat('network:n', CAST(a.n_nationkey AS STRING)), 'CAN_REACH', "
        "concat('network:n', CAST(b.n_nationkey AS STRING)), CAST(0.7 AS DOUBLE), NULL, NULL, NULL "
        "FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey "
        "UNION ALL SELECT concat('user:c', CAST(o_custkey AS STRING)), 'LOGGED_INTO', "
        "concat('host:s', CAST(l_suppkey AS STRING)), CAST(round(0.5 + 0.1 * least(count(*), 5), 4) AS DOUBLE), "
        "min({us_o_orderdate}), max({us_o_orderdate}), "
        "CASE WHEN max(o_orderstatus) = 'F' THEN max({us_o_orderdate}) END "
        "FROM {orders} JOIN {lineitem} ON o_orderkey = l_orderkey WHERE o_orderpriority = '1-URGENT' "
        "GROUP BY o_custkey, l_suppkey "
        "UNION ALL SELECT concat('host:s', CAST(l_suppkey AS STRING)), 'RUNS', "
        "concat('service:p', CAST(l_partkey AS STRING)), CAST(0.95 AS DOUBLE), min({us_l_shipdate}), "
        "max({us_l_shipdate}), NULL FROM {lineitem} WHERE l_linestatus = 'O' AND l_returnflag = 'R' "
        "GROUP BY l_suppkey, l_partkey "
        "UNION ALL SELECT concat('vulnerability:v', CAST(p_size AS STRING), '-', lower(p_brand)), 'AFFECTS', "
        "concat('service:p', CAST(p_partkey AS STRING)), CAST(1.0 AS DOUBLE), NULL, NULL, NULL "
        "FROM {part} WHERE p_size >= 30",
    ),
}


def model_sql(name: str, dialect: dict[str, str] = ANSI) -> str:
    return _fill(MODEL_SQL[name][1], dialect)


def _closure(names: list[str]) -> list[str]:
    out: list[str] = []
    for name in names:
        if name in MODEL_SQL and name not in out:
            for dep in _closure([n for n in MODEL_SQL[name][0] if n in MODEL_SQL]):
                if dep not in out:
                    out.append(dep)
            out.append(name)
    return out


def ansi(uses: str, sql: str) -> str:
    """``sql`` over the model tables named in ``uses`` (space separated), as one ANSI statement."""
    ctes = []
    for name in _closure(uses.split()):
        inputs, _ = MODEL_SQL[name]
        text = model_sql(name)
        for table in inputs:
            text = text.replace("{" + table + "}", table)
        ctes.append(f"{name} AS ({text})")
    head = f"WITH {', '.join(ctes)} " if ctes else ""
    return f"{head}SELECT * FROM ({sql}) final_result"


class Tables:
    """Lazy access to the raw and model tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.sf_dir = spark, sf_dir
        self._cache: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._cache:
            if name in MODEL_SQL:
                inputs, _ = MODEL_SQL[name]
                self._cache[name] = self.spark.sql(
                    model_sql(name, SPARK), **{t: getattr(self, t) for t in inputs}
                )
            else:
                self._cache[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._cache[name]
