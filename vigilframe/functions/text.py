"""Free text: redaction, entropy, SQL statements, injection markers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Shapes of whole tokens that are secrets by themselves.
TOKEN_SHAPES = [
    r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,}\b",
    r"\bgithub_pat_[A-Za-z0-9_]{40,}\b",
    r"\bxox[abposr]-[A-Za-z0-9-]{10,}\b",
    r"\bsk-[A-Za-z0-9_-]{16,}\b",
    r"\beyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b",
]
# Where a secret stands in a text. A key block without its end is masked to the end of the text.
PRIVATE_KEY = r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|$(?!\n))"
BEARER = r"(?i)(\bbearer\s+)"
ASSIGNED = r"(?i)((?:api[_-]?key|apikey|secret|token|passw(?:or)?d|pwd|access[_-]?key)\s*[=:]\s*[\"']?)"
URL_LOGIN = r"(?i)\b([a-z][a-z0-9+.-]{1,20}://[^:/\s@]{1,64}:)([^@\s/]{1,128})(@)"
SQL_PASSWORD = r"(?i)(\b(?:password|identified\s+by)\s+)('[^']*'|\"[^\"]*\"|\S+)"
# Statements that reach outside the database, change access or destroy data.
SQL_RISKS = {
    "file-export": r"(?is)\bcopy\b.+\bto\b\s*(?:'|stdout|program)|\binto\s+(?:out|dump)file\b",
    "file-read": r"(?i)\b(?:pg_read_file|pg_read_binary_file|pg_ls_dir|lo_import|load_file)\s*\(",
    "command-execution": r"(?i)\b(?:xp_cmdshell|copy\b.+\bfrom\s+program|sys_exec|lo_export)\b",
    "privilege-change": r"(?i)\b(?:grant|revoke)\b.+\b(?:to|from)\b|\b(?:create|alter)\s+(?:role|user)\b",
    "destructive": r"(?i)\b(?:drop\s+(?:table|database|schema)|truncate\s+table|truncate\s+\w)",
}
SQL_TABLE = r"(?i)\b(?:from|join|into|update|table|truncate)\s+([A-Za-z_][\w.\"$]*)"


def redact_secret(value: Column) -> Column:
    """``abc****wxyz``; short values are masked whole."""
    t = F.trim(value)
    return (
        F.when(F.length(t) == 0, "")
        .when(F.length(t) <= 11, F.repeat(F.lit("*"), F.least(F.length(t), F.lit(8))))
        .otherwise(F.concat(F.substring(t, 1, 3), F.lit("****"), F.right(t, F.lit(4))))
    )


def _mask_after(text: Column, prefix: str, char: str, least: int) -> Column:
    """Mask the run of ``char`` after ``prefix``: exact length up to 7, eight stars up to 11, ends kept beyond.

    Short runs are masked first, so a masked long run is never looked at again.
    """
    end = f"(?!{char})"
    out = text
    for n in range(least, 8):
        out = F.regexp_replace(out, f"{prefix}{char}{{{n}}}{end}", "$1" + "*" * n)
    if least <= 11:
        out = F.regexp_replace(out, f"{prefix}{char}{{{max(least, 8)},11}}{end}", "$1********")
    return F.regexp_replace(out, f"{prefix}({char}{{3}}){char}{{5,}}({char}{{4}}){end}", "$1$2****$3")


def redact_text(text: Column) -> Column:
    """Secret-looking parts of free text masked, everything else unchanged."""
    out = F.regexp_replace(text, PRIVATE_KEY, "[REDACTED]")
    out = F.regexp_replace(
        out, BEARER + r"([A-Za-z0-9._~+/-]{3})(?=[A-Za-z0-9._~+/-]{9,})[A-Za-z0-9._~+/=-]*([A-Za-z0-9._~+/=-]{4})", "$1$2****$3"
    )
    out = _mask_after(out, ASSIGNED, r"[^\s\"',;]", 4)
    out = _mask_whole(out, "|".join(TOKEN_SHAPES))
    return F.regexp_replace(out, URL_LOGIN, "$1****$3")


def _mask_whole(text: Column, shape: str) -> Column:
    """Every match of ``shape`` as its first three and last four characters."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({shape})"), F.lit(1)))
    return F.aggregate(found, text, lambda acc, m: F.replace(acc, m, redact_secret(m)))


def redact_sql(statement: Column) -> Column:
    return redact_text(F.regexp_replace(statement, SQL_PASSWORD, "$1'****'"))


def sql_verb(statement: Column) -> Column:
    verb = F.regexp_extract(statement, r"(?s)^\s*(?:/\*.*?\*/\s*)?([A-Za-z]+)", 1)
    return F.when(verb != "", F.upper(verb))


def sql_tables(statement: Column) -> Column:
    names = F.regexp_extract_all(statement, F.lit(SQL_TABLE), F.lit(1))
    clean = F.transform(names, lambda x: F.regexp_replace(x, r'^"+|"+$', ""))
    return F.array_distinct(F.filter(clean, lambda x: ~F.lower(x).isin("select", "set", "where")))


def sql_risks(statement: Column) -> Column:
    return F.array_compact(F.array(*[F.when(statement.rlike(p), F.lit(name)) for name, p in SQL_RISKS.items()]))


def entropy(text: Column) -> Column:
    """Shannon entropy in bits per character, over the whole text: one pass per distinct character."""
    distinct = F.filter(F.array_distinct(F.split(text, "")), lambda c: c != "")
    n = F.length(text).cast("double")

    def part(c: Column) -> Column:
        p = (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
        return -p * F.log2(p)

    return F.when(F.length(text) > 0, F.aggregate(F.transform(distinct, part), F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def csv_safe(text: Column) -> Column:
    """Text a spreadsheet will not run as a formula."""
    return F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
