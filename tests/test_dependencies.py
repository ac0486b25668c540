"""Constraints against installed versions, software bills of material and their graphs."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from vigilframe.operators import deps

# constraint, and what it allows of these versions; None: it cannot be read
VERSIONS = ["0.0.3", "0.0.4", "0.2.3", "0.3.0", "1.0.0", "1.2.0", "1.2.3", "1.2.9", "1.3.0", "2.0.0", "2.5.0", "3.0.0"]
CASES = [
    ("npm", "^1.2.3", "1.2.3 1.2.9 1.3.0"), ("npm", "^0.2.3", "0.2.3"), ("npm", "^0.0.3", "0.0.3"), ("npm", "^0", "0.0.3 0.0.4 0.2.3 0.3.0"), ("npm", "^0.0", "0.0.3 0.0.4"), ("npm", "~1.2.3", "1.2.3 1.2.9"),
    ("npm", "~1", "1.0.0 1.2.0 1.2.3 1.2.9 1.3.0"), ("npm", "1.2", "1.2.0 1.2.3 1.2.9"), ("npm", "1.2.x", "1.2.0 1.2.3 1.2.9"), ("npm", "=1.2.3", "1.2.3"), ("npm", ">1.2", "1.3.0 2.0.0 2.5.0 3.0.0"),
    ("npm", "<=1.2", "0.0.3 0.0.4 0.2.3 0.3.0 1.0.0 1.2.0 1.2.3 1.2.9"), ("npm", ">= 1.2.3 < 2.0.0", "1.2.3 1.2.9 1.3.0"), ("npm", "1.2.3 - 2.0.0", "1.2.3 1.2.9 1.3.0 2.0.0"), ("npm", "1.0 - 1.2", "1.0.0 1.2.0 1.2.3 1.2.9"),
    ("npm", "^0.2 || ~2.5.0", "0.2.3 2.5.0"), ("npm", "*", " ".join(VERSIONS)), ("npm", "", " ".join(VERSIONS)), ("npm", ">1.0.0 <1.0.0", ""), ("npm", "latest", None), ("npm", "github:a/b", None), ("npm", "!=1.0.0", " ".join(VERSIONS)),
    ("npm", "~=1.0", None), ("cargo", "1.2.3", "1.2.3 1.2.9 1.3.0"), ("cargo", ">=1.2, <1.3", "1.2.0 1.2.3 1.2.9"), ("cargo", "=1.2.3", "1.2.3"), ("pypi", "==1.2.3", "1.2.3"), ("pypi", "==1.2.*", "1.2.0 1.2.3 1.2.9"),
    ("pypi", "~=1.2.3", "1.2.3 1.2.9"), ("pypi", "~=1.2", "1.2.0 1.2.3 1.2.9 1.3.0"), ("pypi", ">1.2,<=2.0", "1.2.3 1.2.9 1.3.0 2.0.0"), ("pypi", "1.2", "1.2.0"), ("pypi", "!=1.2", " ".join(VERSIONS)), ("pypi", "^1.2.9", "1.2.9 1.3.0"),
    ("pypi", ">=branch", None), ("rubygems", "~> 1.2.3", "1.2.3 1.2.9"), ("rubygems", "~> 1.2", "1.2.0 1.2.3 1.2.9 1.3.0"), ("rubygems", ">= 1.3, < 3", "1.3.0 2.0.0 2.5.0"), ("rubygems", "1.2.x", "1.2.0 1.2.3 1.2.9"),
    ("packagist", "^1.2.9 || 2.5.*", "1.2.9 1.3.0 2.5.0"), ("packagist", "dev-main", None), ("go", "v1.2.3", "1.2.3"), ("go", "main", None), ("npm", "v1.2.3", "1.2.3"), ("npm", "x", " ".join(VERSIONS)), ("npm", ">1.2.2 x", "1.2.3 1.2.9 1.3.0 2.0.0 2.5.0 3.0.0"),
]


def test_constraints_allow_what_their_ecosystem_says(spark):
    declared = spark.createDataFrame([(str(k), eco, "p", text) for k, (eco, text, _) in enumerate(CASES)], "target string, ecosystem string, name string, constraint string")
    ecosystems = sorted({c[0] for c in CASES})
    points = spark.createDataFrame([(v, e, "p", v, None, v) for e in ecosystems for v in VERSIONS], "id string, ecosystem string, name string, introduced string, fixed string, last_affected string")
    got = {}
    for r in deps.vulnerable_constraint(declared, points).collect():
        got.setdefault(int(r.target), set()).add(r.id)
    parsed = {(r.ecosystem, r.constraint): r.parsed for r in deps.constraint_ranges(declared).collect()}
    for k, (eco, text, allowed) in enumerate(CASES):
        assert parsed[eco, text] == (allowed is not None), (eco, text)
        assert got.get(k, set()) == set((allowed or "").split()), (eco, text)


def test_open_and_half_open_advisories(spark):
    declared = spark.createDataFrame([(c, "npm", "p", c) for c in ("^1.2.3", ">=2.0.0", "<1.2.0", "1.2.0")], "target string, ecosystem string, name string, constraint string")
    ranges = spark.createDataFrame([("all", "npm", "p", "0", None, None), ("to12", "npm", "p", "0", "1.2.0", None), ("incl12", "npm", "p", "0", None, "1.2.0"), ("from2", "npm", "p", "2.0.0", None, None), ("other", "npm", "q", "0", None, None)],
                                   "id string, ecosystem string, name string, introduced string, fixed string, last_affected string")
    got = {(r.target, r.id) for r in deps.vulnerable_constraint(declared, ranges).collect()}
    assert got == {("^1.2.3", "all"), (">=2.0.0", "all"), (">=2.0.0", "from2"), ("<1.2.0", "all"), ("<1.2.0", "to12"), ("<1.2.0", "incl12"), ("1.2.0", "all"), ("1.2.0", "incl12")}


def test_bills_of_material_and_their_graph(spark):
    cyclone = {"metadata": {"component": {"bom-ref": "root", "name": "app"}}, "components": [
        {"name": "a", "version": "1", "bom-ref": "a", "purl": "pkg:npm/%40scope/a@1.0.0?arch=x"}, {"name": "b", "version": "2", "bom-ref": "b"}, {"name": "c", "version": "3", "bom-ref": "c"}, {"name": "none", "bom-ref": "n"}],
        "dependencies": [{"ref": "root", "dependsOn": ["a"]}, {"ref": "a", "dependsOn": ["b", "n"]}, {"ref": "b", "dependsOn": ["c", "a"]}, {"ref": "c"}]}
    spdx = {"name": "s", "documentDescribes": ["R"], "packages": [{"SPDXID": "R", "name": "root", "versionInfo": "1"}, {"SPDXID": "X", "name": "x", "versionInfo": "1"}, {"SPDXID": "Y", "name": "y", "versionInfo": "2", "externalRefs": [{"referenceType": "purl", "referenceLocator": "pkg:pypi/y@2.0"}]}],
            "relationships": [{"spdxElementId": "X", "relationshipType": "DEV_DEPENDENCY_OF", "relatedSpdxElement": "Y"}, {"spdxElementId": "X", "relationshipType": "CONTAINS", "relatedSpdxElement": "Y"}]}
    docs = spark.createDataFrame([("c", json.dumps(cyclone)), ("s", json.dumps(spdx)), ("bad", "no json")], "doc string, line string")
    packages, edges = deps.sbom_tables(docs, "doc")
    assert {tuple(r) for r in packages.collect()} == {
        ("c", "npm", "@scope/a", "1.0.0", True), ("c", "generic", "b", "2", False), ("c", "generic", "c", "3", False), ("s", "generic", "x", "1", False), ("s", "pypi", "y", "2.0", True)}
    assert {tuple(r) for r in edges.collect()} == {("c", "npm:@scope/a@1.0.0", "generic:b@2"), ("c", "generic:b@2", "generic:c@3"), ("c", "generic:b@2", "npm:@scope/a@1.0.0"), ("s", "pypi:y@2.0", "generic:x@1")}
    hits = spark.createDataFrame([("generic", "c", "3", "V2"), ("generic", "c", "3", "V1")], "ecosystem string, name string, version string, id string")
    got = {(r.doc, r.node): (r.direct, r.depth, r.via, r.vulnerabilities) for r in deps.dependency_graph(packages, edges, hits, "doc").collect()}
    assert got["c", "generic:c@3"] == (False, 3, "npm:@scope/a@1.0.0", ["V1", "V2"])
    assert got["c", "npm:@scope/a@1.0.0"] == (True, 1, "npm:@scope/a@1.0.0", [])
    assert got["s", "generic:x@1"] == (False, 2, "pypi:y@2.0", [])


def test_only_used_targets_count(spark):
    packages = spark.createDataFrame([("p1", "npm", "p", "1.0.0"), ("p2", "npm", "p", "1.5.0")], "target string, ecosystem string, name string, version string")
    declared = spark.createDataFrame([("d1", "npm", "p", "^1.0.0"), ("d2", "npm", "p", "nonsense")], "target string, ecosystem string, name string, constraint string")
    ranges = spark.createDataFrame([("V", "npm", "p", "0", "1.2.0", None)], "id string, ecosystem string, name string, introduced string, fixed string, last_affected string")
    out = {tuple(r) for r in deps.vulnerable(packages, declared, ranges).select("target", "basis", "version", "constraint", "confidence", F.array_join("advisories", ",")).collect()}
    assert out == {("p1", "exact", "1.0.0", None, 0.9, "V"), ("d1", "constraint", None, "^1.0.0", 0.5, "V")}
    uses = spark.createDataFrame([("d1",)], "target string")
    assert [r.target for r in deps.vulnerable(packages, declared, ranges, uses).collect()] == ["d1"]
