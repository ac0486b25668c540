"""Version texts as keys that Spark compares in the right order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Which scheme an ecosystem uses, and the order of pre-release words.
SCHEMES = {"pypi": "pep440", "npm": "semver", "cargo": "semver", "go": "semver", "semver": "semver"}
PEP440_PRE = {"alpha": 0, "a": 0, "beta": 1, "b": 1, "c": 2, "rc": 2, "pre": 2, "preview": 2}
GENERIC_PRE = {"dev": 0, "snapshot": 0, "alpha": 1, "a": 1, "beta": 2, "b": 2, "milestone": 3, "m": 3, "rc": 4, "cr": 4,
               "c": 4, "pre": 4, "preview": 4}
GENERIC_POST = ["post", "patch", "p", "pl", "rev", "r", "sp"]
GENERIC_RELEASE = ["final", "ga", "release", "stable"]

PEP440 = (
    r"(?i)^\s*v?(?:(\d+)!)?(\d+(?:\.\d+)*)(?:[-_.]?(alpha|beta|preview|pre|rc|a|b|c)[-_.]?(\d+)?)?"
    r"(-\d+|[-_.]?(?:post|rev|r)[-_.]?\d*)?(?:[-_.]?(dev)[-_.]?(\d+)?)?(?:\+[a-z0-9]+(?:[-_.][a-z0-9]+)*)?\s*$"
)
SEMVER = r"^\s*[vV=]*\s*(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:-([0-9A-Za-z.\-]+))?(?:\+[0-9A-Za-z.\-+]*)?\s*$"


# Releases that a shorter version is taken to end in; two versions are told apart unless one goes on with more zeros than this.
PADDING = 24


def _num(text: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")).try_cast("decimal(30,0)"), F.lit(0).cast("decimal(30,0)"))


def _item(kind: Column, number: Column, word: Column) -> Column:
    return F.struct(kind.cast("int").alias("k"), number.cast("double").alias("n"), word.alias("w"))


def _lookup(word: Column, table: dict, default: int) -> Column:
    expr = F.lit(default)
    for k, v in table.items():
        expr = F.when(word == k, F.lit(v)).otherwise(expr)
    return expr


def pep440_key(text: Column) -> Column:
    """Epoch, release without trailing zeros, pre, post, dev; null when the text is not such a version."""

    def g(i: int) -> Column:
        return F.regexp_extract(text, PEP440, i)

    release = F.regexp_replace(g(2), r"(\.0+)+$", "")
    items = F.transform(F.split(release, r"\."), lambda p: _item(F.lit(2), _num(p), F.lit("")))
    pre_word, post, dev = F.lower(g(3)), g(5), g(6)
    post_n = F.regexp_extract(post, r"(\d+)$", 1)
    pre = (
        F.when(pre_word != "", F.array(_item(F.lit(0), _lookup(pre_word, PEP440_PRE, 9), F.lit("")), _item(F.lit(0), _num(g(4)), F.lit(""))))
        .when((dev != "") & (post == ""), F.array(_item(F.lit(-1), F.lit(0), F.lit("")), _item(F.lit(0), F.lit(0), F.lit(""))))
        .otherwise(F.array(_item(F.lit(1), F.lit(0), F.lit("")), _item(F.lit(0), F.lit(0), F.lit(""))))
    )
    tail = F.array(
        F.when(post != "", _item(F.lit(0), _num(post_n), F.lit(""))).otherwise(_item(F.lit(-1), F.lit(0), F.lit(""))),
        F.when(dev != "", _item(F.lit(0), _num(g(7)), F.lit(""))).otherwise(_item(F.lit(1), F.lit(0), F.lit(""))),
    )
    # a shorter release sorts before its continuation: nothing is lower than the end marker
    end = F.array(_item(F.lit(-9), F.lit(0), F.lit("")))
    head = F.array(_item(F.lit(2), _num(g(1)), F.lit("")))
    return F.when(text.rlike(PEP440), F.concat(head, items, end, pre, tail))


def semver_key(text: Column) -> Column:
    """Major, minor, patch, then pre-release identifiers; null when the text is not such a version."""

    def g(i: int) -> Column:
        return F.regexp_extract(text, SEMVER, i)

    pre = g(4)
    idents = F.transform(
        F.split(pre, r"\."),
        lambda p: F.when(p.rlike(r"^\d+$"), _item(F.lit(0), _num(p), F.lit(""))).otherwise(_item(F.lit(1), F.lit(0), p)),
    )
    core = F.array(*[_item(F.lit(2), _num(g(i)), F.lit("")) for i in (1, 2, 3)])
    stage = F.when(pre != "", F.concat(F.array(_item(F.lit(0), F.lit(0), F.lit(""))), idents)).otherwise(
        F.array(_item(F.lit(1), F.lit(0), F.lit(""))))
    return F.when(text.rlike(SEMVER), F.concat(core, stage))


def generic_key(text: Column) -> Column:
    """Number and word tokens; missing tokens count as a release, so 1.0 equals 1.0.0 only by padding."""
    value = F.regexp_replace(F.lower(F.trim(text)), r"^[v=]+", "")
    tokens = F.regexp_extract_all(F.substring_index(value, "+", 1), F.lit(r"(\d+|[a-z]+)"), F.lit(1))

    def item(t: Column) -> Column:
        return (
            F.when(t.rlike(r"^\d+$"), _item(F.lit(2), _num(t), F.lit("")))
            .when(t.isin(GENERIC_RELEASE), _item(F.lit(2), F.lit(0), F.lit("")))
            .when(t.isin(GENERIC_POST), _item(F.lit(2), F.lit(0.5), F.lit("")))
            .otherwise(_item(F.lit(1), _lookup(t, GENERIC_PRE, 9), t))
        )

    # trailing releases go, so that equal versions have equal keys; every other token stays, however many there are, and what follows them is a release
    release = _item(F.lit(2), F.lit(0), F.lit(""))
    items = F.transform(tokens, item)
    last = F.array_position(F.transform(F.reverse(items), lambda i: i != release), True)
    kept = F.when(last > 0, F.slice(items, 1, (F.size(items) - last + 1).cast("int"))).otherwise(F.slice(items, 1, 0))
    return F.when(tokens[0].rlike(r"^\d+$"), F.concat(kept, F.array_repeat(release, PADDING)))


def version_key(ecosystem: Column, text: Column) -> Column:
    """Comparable key under the scheme of the ecosystem, the generic one where that does not parse."""
    scheme = F.lit("generic")
    for eco, name in SCHEMES.items():
        scheme = F.when(ecosystem == eco, name).otherwise(scheme)
    return F.coalesce(F.when(scheme == "pep440", pep440_key(text)).when(scheme == "semver", semver_key(text)), generic_key(text))
