"""Statements of nested packages and of collections."""

import json

from ledgerloom.operators import packages, statements as st
from ledgerloom.sources import tables

A, B, C = (format(k, "02x") * 32 for k in (0, 255, 16))
IDS = {A: "A" * 24, B: "_" * 24, C: "EBAQEBAQEBAQEBAQEBAQEBAQ"}


def test_packages_as_statements(spark, tmp_path):
    full = {
        "submitterId": "s1", "hashSum": A, "fileName": "a.csv", "objectSpecification": "spec1", "isNextVersionOf": [B, C], "preExistingDoi": "10.1/x",
        "specificInfo": {"station": "st", "site": "si", "acquisitionInterval": {"start": "2020-01-01T00:00:00Z", "stop": "2020-02-01T00:00:00Z"}, "instrument": ["i1", "i2"], "samplingHeight": 2.5,
                         "production": {"creator": "p1", "contributors": ["p2", "p3"], "hostOrganization": "o", "comment": "made", "sources": [C], "creationDate": "2020-03-01T00:00:00Z"}},
        "references": {"keywords": [" k1", "", "k2 "], "licence": "cc", "moratorium": "2031-01-01T00:00:00Z"},
    }
    small = {"submitterId": "s2", "hashSum": B, "fileName": "b.csv", "objectSpecification": "spec2", "isNextVersionOf": [C], "partialUpload": True, "specificInfo": {"station": "st", "production": {"creator": "p1", "contributors": ["p2"], "creationDate": "2020-03-01T00:00:00Z"}}, "references": {"moratorium": "2001-01-01T00:00:00Z"}}
    bare = {"submitterId": "unknown", "hashSum": C, "fileName": "c", "objectSpecification": "spec3"}
    (tmp_path / "p.json").write_text("\n".join(json.dumps(x) for x in (full, small, bare, {"fileName": "no hash"})))
    read = tables.read_packages(spark, str(tmp_path / "p.json"))
    found = packages.packages_to_statements(read, spark.createDataFrame([("s1", "org1"), ("s2", "org2")], "submitterId string, org string"), "2025-01-01")
    rows = {(r.subj, r.pred, r.obj) for r in found.collect()}
    a, b, c = IDS[A], IDS[B], IDS[C]
    assert rows == {
        (a, "rdf:type", "DataObject"), (a, "hasObjectSpec", "spec1"), (a, "hasName", "a.csv"), (a, "hasSha256sum", A), (a, "wasSubmittedBy", f"subm_{a}"), (a, "hasDoi", "10.1/x"), (a, "hasKeywords", "k1,k2"), (a, "dcterms:license", "cc"), (a, "isNextVersionOf", b), (a, "isNextVersionOf", c),
        (f"subm_{a}", "rdf:type", "Submission"), (f"subm_{a}", "startedAtTime", "2025-01-01T00:00:00Z"), (f"subm_{a}", "wasAssociatedWith", "org1"), (f"subm_{a}", "endedAtTime", "2031-01-01T00:00:00Z"),
        (a, "wasAcquiredBy", f"acq_{a}"), (f"acq_{a}", "rdf:type", "Acquisition"), (f"acq_{a}", "wasAssociatedWith", "st"), (f"acq_{a}", "wasPerformedAt", "si"), (f"acq_{a}", "startedAtTime", "2020-01-01T00:00:00Z"), (f"acq_{a}", "endedAtTime", "2020-02-01T00:00:00Z"), (f"acq_{a}", "hasSamplingHeight", "2.5"),
        (f"acq_{a}", "wasPerformedWith", "i1"), (f"acq_{a}", "wasPerformedWith", "i2"), (a, "wasProducedBy", f"prod_{a}"), (a, "hadPrimarySource", c), (f"prod_{a}", "rdf:type", "Production"), (f"prod_{a}", "wasPerformedBy", "p1"), (f"prod_{a}", "hasEndTime", "2020-03-01T00:00:00Z"), (f"prod_{a}", "rdfs:comment", "made"),
        (f"prod_{a}", "wasHostedBy", "o"), (f"prod_{a}", "wasParticipatedInBy", f"contribs_{a}"), (f"contribs_{a}", "rdf:type", "rdf:Seq"), (f"contribs_{a}", "rdf:_1", "p2"), (f"contribs_{a}", "rdf:_2", "p3"),
        (b, "rdf:type", "DataObject"), (b, "hasObjectSpec", "spec2"), (b, "hasName", "b.csv"), (b, "hasSha256sum", B), (b, "wasSubmittedBy", f"subm_{b}"), (f"subm_{b}", "rdf:type", "Submission"), (f"subm_{b}", "startedAtTime", "2025-01-01T00:00:00Z"), (f"subm_{b}", "wasAssociatedWith", "org2"),
        (f"next_{c}", "rdf:type", "PlainCollection"), (f"next_{c}", "dcterms:hasPart", b), (f"next_{c}", "isNextVersionOf", c), (b, "wasAcquiredBy", f"acq_{b}"), (f"acq_{b}", "rdf:type", "Acquisition"), (f"acq_{b}", "wasAssociatedWith", "st"),
        (b, "wasProducedBy", f"prod_{b}"), (f"prod_{b}", "rdf:type", "Production"), (f"prod_{b}", "wasPerformedBy", "p1"), (f"prod_{b}", "hasEndTime", "2020-03-01T00:00:00Z"), (f"prod_{b}", "wasParticipatedInBy", "p2"),
        (c, "rdf:type", "DataObject"), (c, "hasObjectSpec", "spec3"), (c, "hasName", "c"), (c, "hasSha256sum", C), (c, "wasSubmittedBy", f"subm_{c}"), (f"subm_{c}", "rdf:type", "Submission"), (f"subm_{c}", "startedAtTime", "2025-01-01T00:00:00Z"),
    }
    kinds = {(r.pred, r.obj_kind, r.lit_attr) for r in found.where("pred in ('hasName', 'hasSamplingHeight', 'wasSubmittedBy', 'startedAtTime')").collect()}
    assert kinds == {("hasName", 1, "xsd:string"), ("hasSamplingHeight", 1, "xsd:float"), ("wasSubmittedBy", 0, None), ("startedAtTime", 1, "xsd:dateTime")}


def test_collections_as_statements(spark):
    rows = [("c1", "T", "D", "org", "10.1/y", ["c0"], ["a", "b"], ["doc"]), ("c2", "U", None, "org", None, None, [], None)]
    found = packages.collections_to_statements(spark.createDataFrame(rows, "id string, title string, description string, creator string, doi string, previous array<string>, members array<string>, documentation array<string>"))
    assert {(r.subj, r.pred, r.obj, r.obj_kind) for r in found.collect()} == {
        ("c1", "rdf:type", "Collection", 0), ("c1", "dcterms:title", "T", 1), ("c1", "dcterms:description", "D", 1), ("c1", "dcterms:creator", "org", 0), ("c1", "hasDoi", "10.1/y", 1), ("c1", "isNextVersionOf", "c0", 0), ("c1", "dcterms:hasPart", "a", 0), ("c1", "dcterms:hasPart", "b", 0), ("c1", "rdfs:seeAlso", "doc", 0),
        ("c2", "rdf:type", "Collection", 0), ("c2", "dcterms:title", "U", 1), ("c2", "dcterms:creator", "org", 0),
    }


def test_current_statements_with_shared_and_own_collections(spark):
    def number(*more, without=()):
        rows = [("new1", "hasName", "a", 1), ("new2", "hasName", "b", 1), ("old", "hasName", "c", 1), ("coll", "rdf:type", "PlainCollection", 0), ("coll", "isNextVersionOf", "old", 0), ("coll", "dcterms:hasPart", "new1", 0), ("coll", "dcterms:hasPart", "new2", 0), *more]
        frame = spark.createDataFrame([(*r, None) for r in rows if r[:3] not in without], "subj string, pred string, obj string, obj_kind int, lit_attr string")
        return st.current_object_statements(frame, spark.createDataFrame([("new2",)], "subj string")).count()

    assert number() == 2
    alone = [("coll", "dcterms:hasPart", "new1")]
    assert number(without=alone) == 4
    provenance = [("new2", "wasSubmittedBy", "subm", 0), ("subm", "startedAtTime", "t", 1), ("new2", "isNextVersionOf", "old", 0), ("new2", "hasCitationString", "x", 1)]
    assert number(*provenance, without=alone) == 7
    contributors = [("new2", "wasProducedBy", "prod", 0), ("prod", "wasParticipatedInBy", "list", 0), ("list", "rdf:type", "rdf:Seq", 0), ("list", "rdf:_1", "p", 0), ("prod", "wasPerformedBy", "q", 0), ("q", "hasName", "Q", 1)]
    assert number(*contributors) == 7
