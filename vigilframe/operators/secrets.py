"""Secret detection in text lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.folds import once
from vigilframe.functions.text import entropy, redact_secret

# Token formats with the confidence of the rule.
TOKENS: dict[str, tuple[str, float]] = {
    "aws-access-key": (r"(?<![A-Za-z0-9])((?:AKIA|ASIA)[A-Z0-9]{16})(?![A-Za-z0-9])", 0.9),
    "github-token": (r"(?<![A-Za-z0-9_])(gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{22,255})(?![A-Za-z0-9_])", 0.95),
    "gitlab-token": (r"(?<![A-Za-z0-9_\-])(glpat-[A-Za-z0-9_\-]{20,255})(?![A-Za-z0-9_\-])", 0.95),
    "slack-token": (r"(?<![A-Za-z0-9\-])(xox[baprs]-[A-Za-z0-9\-]{10,255})(?![A-Za-z0-9\-])", 0.9),
    "stripe-key": (r"(?<![A-Za-z0-9_])((?:sk|rk)_live_[A-Za-z0-9]{16,255})(?![A-Za-z0-9])", 0.95),
    "openai-key": (r"(?<![A-Za-z0-9_\-])(sk-(?:proj-|svcacct-|admin-)?[A-Za-z0-9_\-]{20,255})(?![A-Za-z0-9_\-])", 0.85),
    "google-api-key": (r"(?<![A-Za-z0-9_\-])(AIza[0-9A-Za-z_\-]{35})(?![0-9A-Za-z_\-])", 0.9),
    "jwt": (r"(?<![A-Za-z0-9_\-])(eyJ[A-Za-z0-9_\-]{5,2048}\.eyJ[A-Za-z0-9_\-]{5,}\.[A-Za-z0-9_\-]{8,})(?![A-Za-z0-9_\-])", 0.7),
    "private-key": (r"(-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)", 0.95),
    "url-credentials": (r"(?i)\b[a-z][a-z0-9+.\-]{1,20}://[^\s:/?#@\"'<>]{1,128}:([^\s@/?#\"'<>]{1,256})@[a-z0-9.\-_~%\[\]]+", 0.8),
}
# Words that announce a secret, and the shape of a random-looking string.
KEYWORD = (
    r"(?i)secret|token|passw(?:or)?d|\bpwd\b|credential|api[_\-.]?key|access[_\-.]?key|private[_\-.]?key|\bauth(?:[_\-.]?(?:key|token))?\b|authorization|bearer|"
    r"signing[_\-.]?key|encryption[_\-.]?key|master[_\-.]?key"
)
RANDOM = r"(?<![A-Za-z0-9+/_\-])([A-Za-z0-9+/_\-]{20,512})(?![A-Za-z0-9+/_\-])"
# Words, parts and shapes of values that stand for a secret without being one.
PLACEHOLDER_WORDS = [
    "changeme", "change_me", "change-me", "password", "passwd", "pass", "secret", "token", "apikey", "api_key", "example", "sample", "dummy", "placeholder", "redacted",
    "none", "null", "nil", "true", "false", "undefined", "todo", "tbd", "fixme", "empty", "string", "required", "optional", "your_password", "yourpassword", "mypassword",
    "my_password", "foo", "bar", "foobar",
]
PLACEHOLDER_PARTS = [
    "changeme", "change_me", "change-me", "replace_me", "replace-me", "replaceme", "your_", "your-", "yourpass", "_here", "-here", "example", "placeholder", "dummy",
    "redacted", "xxxx", "****",
]
PLACEHOLDER_SHAPES = [
    r"^\$\{[^}]*\}$",
    r"^\$[A-Za-z_][A-Za-z0-9_]*$",
    r"^\$\(.*\)?$",
    r"\{\{.*\}\}",
    r"^%\(.+\)s$|^%s$",
    r"^#\{.*\}$|^%\{.*\}$",
    r"^@[\w.\-]+@$",
    r"^__\w+__$",
    r"^<[^<>]*>$",
    r"^\[[^\[\]]*\]$",
    r"^[xX*•._#\-]+$",
    r"(?i)^(?:ENC\[|vault:|op://|ref\+|arn:aws:|secretsmanager:|sm://|env:|ENV\[)",
    r"^[*&!]",
]
# Paths that look like tests.
TEST_PATH = r"(?i)(^|[/_.\-])(tests?|specs?|fixtures?|examples?|samples?|mocks?|docs?)([/_.\-]|$)"


# What a line must hold for a rule's pattern to match at all.
GATES = {"github-token": "_", "gitlab-token": "glpat-", "slack-token": "xox", "stripe-key": "k_live_", "openai-key": "sk-", "google-api-key": "AIza", "jwt": "eyJ", "private-key": "PRIVATE KEY", "url-credentials": "://"}


def is_placeholder(value: Column, key: Column | None = None) -> Column:
    """Whether a value only stands for a secret. ``key``: the name it was assigned to; a value that repeats its own name, or the last part of it, is one."""
    t = F.regexp_replace(F.trim(value), r"^[\"']+|[\"']+$", "")
    low = F.lower(t)
    found = (F.length(t) < 4) | low.isin(PLACEHOLDER_WORDS) | F.contains(t, F.lit("EXAMPLE"))
    if key is not None:
        name = F.lower(key)
        found = found | F.coalesce((low == name) | (low == F.substring_index(name, "_", -1)), F.lit(False))
    for part in PLACEHOLDER_PARTS:
        found = found | F.contains(low, F.lit(part))
    for shape in PLACEHOLDER_SHAPES:
        found = found | t.rlike(shape)
    return found


# A cloud secret key has no shape of its own; its line must name it.
CLOUD_SECRET = r"(?<![A-Za-z0-9/+])([A-Za-z0-9/+]{40})(?![A-Za-z0-9/+=])"
CLOUD_SECRET_LINE = r"(?i)(?:aws|amazon)[\w.\-]{0,30}?secret|secret[_\-. ]?access[_\-. ]?key"
CLOUD_SECRET_BITS = 3.5
CLOUD_SECRET_CONFIDENCE = 0.7


# Names of credentials: last words, their endings, and pairs of last words; what is assigned to them has this confidence.
SECRET_WORDS = ["password", "passwd", "pwd", "pass", "passphrase", "secret", "token", "apikey"]
SECRET_ENDINGS = ["password", "passwd", "secret", "token", "apikey"]
SECRET_PAIRS = ["api key", "secret key", "app key", "master key", "encryption key", "signing key"]
ASSIGNMENT_CONFIDENCE = 0.6
# A name, a sign of assignment and a value, quoted or bare; an XML element that holds a value. Group 1 is the name, group 2 the value.
ASSIGNED = r"""([A-Za-z_][A-Za-z0-9_.\-]{0,80})["']?\s*(?::=|=>|=|:)\s*("[^"]{1,512}"|'[^']{1,512}'|[^\s"'<>,;]{1,512})"""
ELEMENT = r"<([A-Za-z_][A-Za-z0-9_.\-]{0,80})>([^<>\s][^<>]{0,255})</\1>"


def key_parts(key: Column) -> Column:
    """Lower-case words of a name in snake, kebab, dotted or camel case."""
    spaced = F.regexp_replace(F.regexp_replace(key, "([A-Z]+)([A-Z][a-z])", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.filter(F.split(F.lower(spaced), r"[\s_.\-]+"), lambda p: p != "")


def is_secret_key(key: Column) -> Column:
    """Whether a name is that of a credential: by its last word, or its last two."""

    def named(parts: Column) -> Column:
        last = F.element_at(parts, -1)
        ending = F.lit(False)
        for word in SECRET_ENDINGS:
            ending = ending | last.endswith(word)
        return (F.size(parts) > 0) & (last.isin(SECRET_WORDS) | ending | F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), " ").isin(SECRET_PAIRS))

    return once(key_parts(key), named)


def assignments(lines: DataFrame, key: str, config: Column | None = None) -> DataFrame:
    """(key, line, rule, value): what names of credentials are set to. Bare values and XML elements count in configuration files only (``config``); elsewhere a bare
    value is an expression. Numbers, paths, addresses and placeholders are none."""
    pair = lambda pattern: F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("name"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("raw"))
    found = F.when(F.col("content").rlike(r"[=:]|</"), F.concat(pair(ASSIGNED), F.transform(pair(ELEMENT), lambda p: F.struct(p["name"].alias("name"), p["raw"].alias("raw")))))
    rows = lines.withColumn("config_", config if config is not None else F.lit(False)).select(key, "line", "config_", F.inline(found))
    quoted = F.col("raw").rlike("""^"[^"]*"$|^'[^']*'$""")
    rows = rows.withColumns({"quoted": quoted, "value": F.when(quoted, F.expr("substring(raw, 2, length(raw) - 2)")).otherwise(F.col("raw"))}).where("quoted OR config_")
    path = F.contains("value", F.lit("://")) | F.col("value").rlike(r"^(/|\./|\.\./|~/).*/")
    plain = ~F.col("value").rlike(r"^\d+$") & ~path & (F.trim("value") != "") & is_secret_key(F.col("name"))
    return rows.where(plain & ~is_placeholder(F.col("value"), F.element_at(key_parts(F.col("name")), -1))).select(key, "line", F.lit("assignment").alias("rule"), "value")


def scan(texts: DataFrame, key: str, text: str = "text", threshold: float = 4.5, config: Column | None = None) -> DataFrame:
    """(key, line, rule, value) of every candidate in whole texts, placeholders left out. ``config``: whether a row of ``texts`` is a configuration file."""
    named_config = texts.withColumn("config_", config if config is not None else F.lit(False))
    lines = named_config.select(key, "config_", F.posexplode(F.split(F.col(text), "\n")).alias("n", "content")).select(key, "config_", (F.col("n") + 1).alias("line"), "content")
    none = F.expr("CAST(array() AS array<struct<rule:string,value:string>>)")

    def named(rule: str, pattern: str) -> Column:
        values = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        return F.transform(values, lambda v: F.struct(F.lit(rule).alias("rule"), v.alias("value")))

    found = [F.when(F.contains("content", F.lit(GATES[rule])), named(rule, pattern)).otherwise(none) if rule in GATES else named(rule, pattern) for rule, (pattern, _) in TOKENS.items()]
    cloud = F.filter(named("aws-secret-access-key", CLOUD_SECRET), lambda h: h["value"].rlike(r"\d") & h["value"].rlike("[a-z]") & h["value"].rlike("[A-Z]") & (entropy(h["value"]) >= CLOUD_SECRET_BITS))
    found.append(F.when(F.col("content").rlike(CLOUD_SECRET_LINE), cloud).otherwise(none))
    hits = lines.select(key, "line", F.explode(F.flatten(F.array(*found))).alias("h")).select(key, "line", "h.*").where(~is_placeholder(F.col("value")))
    hits = hits.unionByName(assignments(lines, key, F.col("config_"))).distinct()
    near = lines.where(F.col("content").rlike(KEYWORD)).select(key, "line", F.explode(F.regexp_extract_all("content", F.lit(RANDOM), F.lit(1))).alias("value"))
    is_hex = F.col("value").rlike(r"^[0-9a-fA-F]+$")
    mixed = F.when(is_hex, F.col("value").rlike(r"\d")).otherwise(F.col("value").rlike(r"\d") & F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]"))
    random = near.where(mixed & ~F.col("value").rlike(r"^[a-z0-9._\-]+(?:/[a-z0-9._\-]+){2,}$")).withColumn("bits", entropy(F.col("value")))
    random = random.where((F.col("bits") >= F.when(is_hex, threshold * 4 / 6).otherwise(threshold)) & ~is_placeholder(F.col("value"))).select(key, "line", F.lit("high-entropy").alias("rule"), "value").distinct()
    # a value another rule already names is not reported again
    return hits.unionByName(random.join(hits.select(key, "line", "value"), [key, "line", "value"], "left_anti"))


def confidence(rule: Column, path: Column) -> Column:
    """Precision of the rule, lowered for paths that look like tests; 0.05 to 0.99."""
    base = F.when(rule == "aws-secret-access-key", CLOUD_SECRET_CONFIDENCE).when(rule == "assignment", ASSIGNMENT_CONFIDENCE).otherwise(F.lit(0.5))
    for name, (_, score) in TOKENS.items():
        base = F.when(rule == name, score).otherwise(base)
    return F.round(F.greatest(F.lit(0.05), F.least(F.lit(0.99), base - F.when(path.rlike(TEST_PATH), 0.3).otherwise(0.0))), 4)


def fingerprint(value: Column, salt: Column) -> Column:
    """Keyed digest: equal secrets group without being stored."""
    return F.substring(F.sha2(F.concat(salt, F.lit("\x1f"), F.sha2(F.concat(salt, F.lit("\x1f"), value), 256)), 256), 1, 16)


def report(hits: DataFrame, key: str, salt: str) -> DataFrame:
    """One row per secret: redacted value, places, rules."""
    h = hits.withColumns({"fingerprint": fingerprint(F.col("value"), F.lit(salt)), "shown": redact_secret(F.col("value"))})
    places = h.select("fingerprint", key, "line").distinct().groupBy("fingerprint").agg(F.count("*").alias("places"))
    rules = h.groupBy("fingerprint").agg(F.min("shown").alias("shown"), F.array_join(F.array_sort(F.collect_set("rule")), ",").alias("rules"))
    return rules.join(places, "fingerprint")


def allowlisted(hits: DataFrame, rules: list[str] | None = None, globs: list[str] | None = None) -> Column:
    """Whether a hit (columns rule, path) is allowed by rule or by a path glob."""
    out = F.col("rule").isin(rules or [])
    for g in globs or []:
        pattern = "".join(".*" if ch == "*" else "." if ch == "?" else f"\\{ch}" if not ch.isalnum() else ch for ch in g)
        out = out | F.col("path").rlike(f"^{pattern}$")
    return out


def without_allowed(hits: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """Hits (column fingerprint) whose fingerprint is not in the allowlist."""
    return hits.join(fingerprints.select("fingerprint").distinct(), "fingerprint", "left_anti")
