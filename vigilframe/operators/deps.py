"""Packages, advisories and their version ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.versions import version_key
from vigilframe.operators.graph import union_all
from vigilframe.operators.loops import cut

CYCLONEDX = (
    "metadata struct<component:struct<`bom-ref`:string,name:string,version:string>>, components array<struct<type:string,name:string,group:string,version:string,scope:string,purl:string,`bom-ref`:string>>, "
    "dependencies array<struct<ref:string,dependsOn:array<string>>>")
SPDX = (
    "name string, documentDescribes array<string>, packages array<struct<SPDXID:string,name:string,versionInfo:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>>, "
    "relationships array<struct<spdxElementId:string,relationshipType:string,relatedSpdxElement:string>>")
OSV = "id string, affected array<struct<package:struct<ecosystem:string,name:string>,ranges:array<struct<type:string,events:array<struct<introduced:string,fixed:string,last_affected:string>>>>>>"
PURL = r"^pkg:([A-Za-z0-9.+-]+)/([^@?#]+)(?:@([^?#]+))?"


def _package(purl: Column, name: Column, version: Column) -> list[Column]:
    """(ecosystem, name, version) of a package URL, else of the plain fields."""
    part = lambda k: F.nullif(F.regexp_extract(purl, PURL, k), F.lit(""))
    decoded = lambda c: F.url_decode(F.regexp_replace(c, r"\+", "%2B"))
    return [F.coalesce(F.lower(part(1)), F.lit("generic")).alias("ecosystem"), F.coalesce(decoded(part(2)), name).alias("name"), F.coalesce(decoded(part(3)), version).alias("version")]


def sbom_tables(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Packages (key, ecosystem, name, version, direct) and edges (key, parent, child) of CycloneDX and SPDX documents in column ``line``; packages are named
    ``ecosystem:name@version`` in edges.

    Entries without a version are left out, with their edges. Where the document names what its root depends on, that is direct; else what no package depends on.
    """
    c = docs.select(key, F.from_json("line", CYCLONEDX).alias("d")).where("d.components IS NOT NULL")
    x = docs.select(key, F.from_json("line", SPDX).alias("d")).where("d.packages IS NOT NULL")
    c_root = F.col("d.metadata.component.bom-ref")
    described = F.transform(F.filter("d.relationships", lambda r: (F.upper(r["relationshipType"]) == "DESCRIBES") & (r["spdxElementId"] == "SPDXRef-DOCUMENT")), lambda r: r["relatedSpdxElement"])
    roots = F.concat(F.coalesce("d.documentDescribes", F.array().cast("array<string>")), F.coalesce(described, F.array().cast("array<string>")))
    x = x.withColumn("roots", roots)
    refs_c = c.select(key, F.explode("d.components").alias("p")).select(key, F.coalesce("p.bom-ref", "p.purl").alias("ref"), *_package(F.col("p.purl"), F.col("p.name"), F.col("p.version")))
    locator = F.filter("p.externalRefs", lambda r: F.lower(r["referenceType"]) == "purl")
    refs_x = x.select(key, "roots", F.explode("d.packages").alias("p")).where("NOT array_contains(roots, p.SPDXID)").select(key, F.col("p.SPDXID").alias("ref"), *_package(F.get(locator, F.lit(0))["referenceLocator"], F.col("p.name"), F.col("p.versionInfo")))
    refs = refs_c.unionByName(refs_x).where("version IS NOT NULL AND name IS NOT NULL").withColumn("node", F.concat("ecosystem", F.lit(":"), "name", F.lit("@"), "version"))
    links_c = c.select(key, c_root.alias("root"), F.explode("d.dependencies").alias("e")).select(key, F.col("e.ref").alias("a"), F.explode("e.dependsOn").alias("b"), (F.col("root") == F.col("e.ref")).alias("from_root"))
    kind = F.upper(F.col("r.relationshipType"))
    backward = kind.endswith("DEPENDENCY_OF")
    links_x = x.select(key, "roots", F.explode("d.relationships").alias("r")).where((kind == "DEPENDS_ON") | backward)
    links_x = links_x.select(key, "roots", F.when(backward, F.col("r.relatedSpdxElement")).otherwise(F.col("r.spdxElementId")).alias("a"), F.when(backward, F.col("r.spdxElementId")).otherwise(F.col("r.relatedSpdxElement")).alias("b"))
    links = links_c.unionByName(links_x.select(key, "a", "b", F.array_contains("roots", F.col("a")).alias("from_root")))
    child = links.join(refs.select(key, F.col("ref").alias("b"), F.col("node").alias("child")), [key, "b"])
    edges = child.join(refs.select(key, F.col("ref").alias("a"), F.col("node").alias("parent")), [key, "a"]).where("parent <> child").select(key, "parent", "child").distinct()
    named = child.where("from_root").select(key, F.col("child").alias("node")).distinct()
    explicit = named.select(key).distinct().withColumn("explicit", F.lit(True))
    pointed = edges.select(key, F.col("child").alias("node")).distinct().withColumn("pointed", F.lit(True))
    packages = refs.select(key, "ecosystem", "name", "version", "node").distinct().join(named.withColumn("named", F.lit(True)), [key, "node"], "left").join(explicit, key, "left").join(pointed, [key, "node"], "left")
    direct = F.when(F.col("explicit"), F.col("named").isNotNull()).otherwise(F.col("pointed").isNull())
    return packages.select(key, "ecosystem", "name", "version", direct.alias("direct")), edges


def dependency_graph(packages: DataFrame, edges: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """(key, node, direct, depth, via, vulnerabilities): packages with their distance from the project (1: direct; null: nothing leads there), the direct package
    on the shortest way (the first by name among equals), and the advisories of ``hits(ecosystem, name, version, id)``.

    One level of the graph is one join; a package is taken up once, so circles end; every level is cut.
    """
    node = F.concat("ecosystem", F.lit(":"), "name", F.lit("@"), "version")
    nodes = packages.select(key, node.alias("node"), "ecosystem", "name", "version", "direct")
    arcs = cut(edges.select(key, F.col("parent").alias("node"), "child"))
    frontier = cut(nodes.where("direct").select(key, "node", F.col("node").alias("via"), F.lit(1).alias("depth")))
    levels = [frontier]
    while not frontier.isEmpty():
        known = union_all([x.select(key, "node") for x in levels])
        step = frontier.join(arcs, [key, "node"]).groupBy(key, F.col("child").alias("node")).agg(F.min("via").alias("via"), (F.max("depth") + 1).alias("depth"))
        frontier = cut(step.join(known, [key, "node"], "left_anti"))
        levels.append(frontier)
    reached = union_all(levels)
    found = hits.select("ecosystem", "name", "version", "id").distinct().groupBy("ecosystem", "name", "version").agg(F.array_sort(F.collect_set("id")).alias("vulnerabilities"))
    out = nodes.join(reached, [key, "node"], "left").join(found, ["ecosystem", "name", "version"], "left")
    return out.select(key, "node", "direct", "depth", "via", F.coalesce("vulnerabilities", F.array().cast("array<string>")).alias("vulnerabilities"))


def osv_intervals(docs: DataFrame) -> DataFrame:
    """(id, ecosystem, name, introduced, fixed, last_affected): each introduction with the event that ends it."""
    j = docs.select(F.from_json("line", OSV).alias("d")).select("d.id", F.explode("d.affected").alias("a")).select(
        "id", F.lower("a.package.ecosystem").alias("ecosystem"), "a.package.name", F.posexplode("a.ranges").alias("r_no", "r")).select(
        "id", "ecosystem", "name", "r_no", F.posexplode("r.events").alias("e_no", "e"))
    w = Window.partitionBy("id", "ecosystem", "name", "r_no").orderBy("e_no")
    ends = F.lead(F.struct("e.fixed", "e.last_affected")).over(w)
    return j.withColumn("end", ends).where("e.introduced IS NOT NULL").select(
        "id", "ecosystem", "name", F.col("e.introduced").alias("introduced"), F.col("end.fixed").alias("fixed"), F.col("end.last_affected").alias("last_affected"))


def vulnerable_exact(packages: DataFrame, ranges: DataFrame) -> DataFrame:
    """Installed versions inside an advisory range: equal (ecosystem, name), then version keys compared."""
    j = packages.join(ranges, ["ecosystem", "name"])
    eco = F.col("ecosystem")
    v = version_key(eco, F.col("version"))
    after = (F.col("introduced") == "0") | (v >= version_key(eco, F.col("introduced")))
    before = F.col("fixed").isNull() | (v < version_key(eco, F.col("fixed")))
    until = F.col("last_affected").isNull() | (v <= version_key(eco, F.col("last_affected")))
    return j.where(after & before & until).withColumn("confidence", F.lit(0.9))


# Operators of constraints, longest first; what stands in front of no version range.
OPERATORS = r"===|==|~=|!=|<=|>=|~>|<|>|=|\^|~"
NOT_A_RANGE = r"^(file:|link:|git|https?:|github:|gitlab:|bitbucket:|workspace:|portal:|patch:)|/"
PARTIAL = r"^[vV]?(\d+(?:\.(?:\d+|[xX*]))*|[xX*])([-+][0-9A-Za-z.+\-]*)?$"


def _clauses(declared: DataFrame) -> DataFrame:
    """(ecosystem, constraint, whole, group_no, op, version): alternatives and their clauses; an open alternative has a null operator."""
    eco, text = F.col("ecosystem"), F.trim("constraint")
    open_text = (text == "") | (text == "*")
    groups = F.when(eco == "npm", F.split(text, r"\|\|")).when(eco.isin("pypi", "packagist"), F.split(text, r"\|\|?")).otherwise(F.array(text))
    d = declared.select("ecosystem", "constraint").distinct().withColumn("whole", (eco != "go") & open_text)
    g = d.select("ecosystem", "constraint", "whole", F.posexplode(groups).alias("group_no", "g")).withColumn("g", F.trim("g"))
    tight = F.regexp_replace("g", rf"({OPERATORS})\s+", "$1")
    between = F.col("ecosystem").isin("npm", "packagist") & F.col("g").rlike(r"^\S+\s+-\s+\S+$")
    parts = (F.when(between, F.array(F.concat(F.lit("from "), F.split_part("g", F.lit(" "), F.lit(1))), F.concat(F.lit("upto "), F.regexp_extract("g", r"(\S+)$", 1))))
             .when(F.col("ecosystem") == "npm", F.split(tight, r"\s+")).when(F.col("ecosystem").isin("cargo", "pypi"), F.split(tight, r"\s*,\s*"))
             .when(F.col("ecosystem") == "go", F.array("g")).otherwise(F.split(tight, r"[,\s]+")))
    rows = g.select("ecosystem", "constraint", "whole", "group_no", F.explode_outer(F.filter(parts, lambda c: c != "")).alias("clause"))
    op = F.regexp_extract("clause", rf"^(from |upto |{OPERATORS})?", 1)
    return rows.withColumns({"op": F.trim(op), "version": F.trim(F.substring("clause", F.length(op) + 1, F.length("clause")))})


def constraint_ranges(declared: DataFrame) -> DataFrame:
    """(ecosystem, constraint, parsed, low, high): the versions that each alternative of a declared constraint allows, between (key, open) and (key, closed).

    Understands ``^ ~ ~> ~= > >= < <= = == === !=``, ``1.x`` and ``1.*``, ``A - B``, bare versions, several clauses and alternatives, each as the ecosystem reads them;
    ``!=`` takes nothing away. A constraint with anything else (tags, addresses, branches) has one row with ``parsed`` false.
    """
    c = _clauses(declared)
    eco, op, version = F.col("ecosystem"), F.col("op"), F.col("version")
    semver, pypi, go = eco.isin("npm", "cargo"), eco == "pypi", eco == "go"
    other = ~(semver | pypi | go)
    # x-ranges of other ecosystems end in .* or .x; what is before them counts
    starred = (pypi & version.endswith(".*")) | (other & (F.contains(version, F.lit("*")) | F.lower(version).endswith(".x")))
    bare = F.when(pypi & starred, F.regexp_replace(version, r"\.\*$", "")).when(other & starred, F.coalesce(F.nullif(F.regexp_replace(version, r"[*xX]+$|\.[*xX]+$", ""), F.lit("")), F.lit("*"))).otherwise(version)
    c = c.withColumn("bare", bare)
    given = F.regexp_extract("bare", PARTIAL, 1)
    lead = F.regexp_extract(given, r"^\d+(\.\d+)*", 0)
    c = c.withColumns({"is_partial": F.col("bare").rlike(PARTIAL), "lead": lead, "is_full": (lead == given) & (F.size(F.split(lead, r"\.")) >= 3), "n": F.when(lead != "", F.split(lead, r"\.")).otherwise(F.array().cast("array<string>"))})
    size = F.size("n")

    def three(numbers: Column) -> Column:
        return F.array_join(F.concat(numbers, F.array_repeat(F.lit("0"), F.greatest(3 - F.size(numbers), F.lit(0)))), ".")

    def bump(position: Column) -> Column:
        """The next version after all that share the components up to a position."""
        return three(F.concat(F.slice("n", F.lit(1), F.greatest(position, F.lit(0))), F.array((F.get(F.col("n"), position).cast("decimal(30,0)") + 1).cast("string"))))

    text = F.when(F.col("is_full"), F.regexp_replace("bare", "^[vV]+", "")).otherwise(three(F.col("n")))
    plain = F.when(pypi | go, version).otherwise(F.regexp_replace(version, "^[vV]+", ""))
    first_set = F.when((size == 1) | (F.get("n", F.lit(0)).cast("decimal(30,0)") != 0), 0).when((size == 2) | (F.get("n", F.lit(1)).cast("decimal(30,0)") != 0), 1).otherwise(2)
    upper = bump(size - 1)
    # how a clause is read
    kind = (
        F.when(F.col("clause").isNull() | (op == "!=") | (pypi & version.isin("*", "")), "all").when(go, F.when(version.rlike(r"^v?\d") & (op == ""), "exact").otherwise("bad"))
        .when(op.isin("from", "upto"), op).when(starred, "x").when(op == "^", "caret").when(op.isin("~", "~>") & semver, "tilde").when((op == "~") & pypi, "tilde").when(op.isin("~", "~>") & other, "pessimistic")
        .when((op == "~=") & pypi, "pessimistic").when((op == "") & (eco == "cargo"), "caret").when(op.isin("", "=", "==") & semver, "x").when(op.isin("", "=", "==") | ((op == "===") & pypi), "exact")
        .when(op.isin("<", "<=", ">", ">="), F.when(semver & ~F.col("is_full"), F.concat(F.lit("loose"), op)).when(semver, op).otherwise(F.concat(F.lit("plain"), op))).otherwise("bad"))
    c = c.withColumns({"kind": kind, "text": text, "plain": plain, "upper": upper})
    k, needs = F.col("kind"), ~F.col("kind").isin("all", "exact", "bad") & ~F.col("kind").startswith("plain")
    nothing = needs & (size == 0)  # a lone wildcard
    low = (F.when(k.isin("x", "caret", "tilde", "pessimistic", "from", ">=", "loose>=", ">"), F.col("text")).when(k == "loose>", F.col("upper")).when(k.isin("exact", "plain>=", "plain>"), F.col("plain")))
    high = (
        F.when((k == "x") & F.col("is_full"), F.col("text")).when(k.isin("x", "loose<="), F.col("upper")).when(k == "caret", bump(first_set)).when(k == "tilde", bump(F.when(size == 1, 0).otherwise(1)))
        .when(k == "pessimistic", bump(F.greatest(size - 2, F.lit(0)))).when(k == "upto", F.when(F.col("is_full"), F.col("text")).otherwise(F.col("upper"))).when(k.isin("<", "<=", "loose<"), F.col("text"))
        .when(k.isin("exact", "plain<", "plain<="), F.col("plain")))
    closed = ((k == "x") & F.col("is_full")) | ((k == "upto") & F.col("is_full")) | k.isin("<=", "exact", "plain<=")
    c = c.withColumns({"low": F.when(~nothing, low), "high": F.when(~nothing, high), "open": k.isin(">", "plain>").cast("int"), "closed": closed.cast("int")})
    c = c.withColumns({"low_key": F.when(F.col("low").isNotNull(), version_key(eco, F.col("low"))), "high_key": F.when(F.col("high").isNotNull(), version_key(eco, F.col("high")))})
    unread = (k == "bad") | (needs & ~F.col("is_partial")) | (F.col("low").isNotNull() & F.col("low_key").isNull()) | (F.col("high").isNotNull() & F.col("high_key").isNull())
    words = F.col("constraint").rlike(NOT_A_RANGE) | ~F.col("constraint").rlike(r"\d|^\s*[*xX]?\s*$")
    unread = ~F.col("whole") & (unread | (F.trim("constraint") == "latest") | ((eco == "npm") & words) | ((eco == "packagist") & F.col("constraint").rlike(r"(^|\s|\|)dev-")))
    g = c.groupBy("ecosystem", "constraint", "whole", "group_no").agg(
        F.bool_or(unread).alias("unread"), F.max(F.when(F.col("low_key").isNotNull(), F.struct(F.col("low_key").alias("key"), "open"))).alias("low"),
        F.min(F.when(F.col("high_key").isNotNull(), F.struct(F.col("high_key").alias("key"), "closed"))).alias("high"))
    bad = g.groupBy("ecosystem", "constraint").agg(F.bool_or("unread").alias("bad"))
    j = g.join(bad, ["ecosystem", "constraint"]).where("NOT bad OR group_no = 0")
    none = lambda c: F.when(~F.col("bad") & ~F.col("whole"), F.col(c)).alias(c)
    return j.select("ecosystem", "constraint", (~F.col("bad")).alias("parsed"), none("low"), none("high"))


def vulnerable_constraint(declared: DataFrame, ranges: DataFrame) -> DataFrame:
    """Declared constraints (columns ``ecosystem``, ``name``, ``constraint`` and others) that allow a version in an advisory range; one row per declaration and range.

    Distinct constraints are read once. What cannot be read allows nothing here; ``constraint_ranges`` counts it.
    """
    allowed = constraint_ranges(declared).where("parsed").select("ecosystem", "constraint", F.col("low").alias("c_low"), F.col("high").alias("c_high"))
    eco = F.col("ecosystem")
    bound = lambda c, flag, name, value: F.when(F.col(c).isNotNull() & (F.col(c) != "0"), F.struct(version_key(eco, F.col(c)).alias("key"), F.lit(value).alias(flag))).alias(name)
    r = ranges.select("*", bound("introduced", "open", "a_low", 0), F.coalesce(bound("fixed", "closed", "x", 0), bound("last_affected", "closed", "x", 1)).alias("a_high"))
    j = declared.join(r, ["ecosystem", "name"]).join(allowed, ["ecosystem", "constraint"])
    low, high = F.greatest("c_low", "a_low"), F.least("c_high", "a_high")
    j = j.withColumns({"low_": low, "high_": high})
    meets = F.col("low_").isNull() | F.col("high_").isNull() | (F.col("low_.key") < F.col("high_.key")) | ((F.col("low_.key") == F.col("high_.key")) & (F.col("low_.open") == 0) & (F.col("high_.closed") == 1))
    keep = [*dict.fromkeys([*declared.columns, *ranges.columns])]
    return j.where(meets).select(*keep).distinct().withColumn("confidence", F.lit(0.5))


def vulnerable(packages: DataFrame, declared: DataFrame, ranges: DataFrame, uses: DataFrame | None = None) -> DataFrame:
    """(target, basis, version, constraint, confidence, advisories): installed ``packages(target, ecosystem, name, version)`` inside an advisory range, and declared
    dependencies without an installed version, ``declared(target, ecosystem, name, constraint)``, that allow one. With ``uses(target)`` only what a project uses."""
    exact = vulnerable_exact(packages, ranges).select("target", F.lit("exact").alias("basis"), "version", F.lit(None).cast("string").alias("constraint"), "confidence", "id")
    loose = vulnerable_constraint(declared, ranges).select("target", F.lit("constraint").alias("basis"), F.lit(None).cast("string").alias("version"), "constraint", "confidence", "id")
    hits = exact.unionByName(loose)
    if uses is not None:
        hits = hits.join(uses.select("target").distinct(), "target", "left_semi")
    g = hits.groupBy("target", "basis").agg(F.max("version").alias("version"), F.min("constraint").alias("constraint"), F.max("confidence").alias("confidence"), F.array_sort(F.collect_set("id")).alias("advisories"))
    return g.select("target", "basis", "version", "constraint", "confidence", "advisories")


def pair_versions(removed: DataFrame, added: DataFrame, eco: str = "semver") -> DataFrame:
    """Newest removed with newest added version of a package, then the next ones."""
    key = version_key(F.lit(eco), F.col("version"))

    def ranked(df, name):
        w = Window.partitionBy("package").orderBy(F.desc("k"), F.desc("version"))
        return df.withColumn("k", key).withColumn("rn", F.row_number().over(w)).select("package", "rn", F.col("version").alias(name))

    return ranked(removed, "from_version").join(ranked(added, "to_version"), ["package", "rn"], "full_outer")


def project_summary(packages: DataFrame, hits: DataFrame) -> DataFrame:
    g = packages.groupBy("project").agg(F.count("*").alias("packages"), F.count_if("direct").alias("direct"))
    v = hits.groupBy("project").agg(F.count("*").alias("open_findings"))
    return g.join(v, "project", "left").select("project", "packages", "direct", F.coalesce("open_findings", F.lit(0).cast("long")).alias("open_findings"))
