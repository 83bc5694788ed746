import re

import plain
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from fleetlens.llm import license_scan
from fleetlens.llm.license_rules import FAMILIES, rules

SF = "/root/testdata/sf0.01"
RULES = [(name, label, re.compile(pattern, re.ASCII), weight) for name, label, _, _, pattern, weight in rules()]


def expected(text):
    """Every rule over every text, without gates."""
    low, w = plain.lower(text), plain.words(text)
    starts, base = [], set()
    for phrase, label in license_scan.PHRASES:
        parts = phrase.split()
        found = [i for i in range(len(w) - len(parts) + 1) if w[i : i + len(parts)] == parts]
        starts += found
        base |= {label} if found else set()
    places = sorted((m.start(), -len(m[0]), k, m.end()) for k, (_, _, p, _) in enumerate(RULES) for m in p.finditer(low))
    kept, to = [], -1
    for s, _, k, e in places:
        if e > to:
            kept.append((s, e, RULES[k][0]))
            to = e
    by_name = {name: (label, weight) for name, label, _, weight in RULES}
    labels = base | {by_name[k][0] for _, _, k in kept}
    score = max([by_name[k][1] for _, _, k in kept] + [license_scan.PHRASE_WEIGHT if starts else 0.0])
    return (
        len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score,
        [tuple(k) for k in kept],
    )


def notices():
    out = []
    for k, (label, _, spdx, names, address) in enumerate(FAMILIES):
        name = {"gpl": "GNU General Public License", "cc-by": "Creative Commons Attribution", "cc0": "CC0 1.0"}.get(label, label.replace("-", " ") + " License")
        out.append(f"Text {k}.\nThis work is licensed under the {name}, version 3.\nMore. SPDX-License-Identifier: {spdx.split('|')[0]}")
        out.append(f"Released under the {name}; see https://www.{address} or https://example.org/{label}")
    return out + [
        "CC BY CC BY-NC 4.0 cc\nby", "mit license MIT LICENSE mit-license", "gnu general public gnu general public license" * 3,
        "licensed under the apache license, version 2.0", "permission is hereby granted, free of charge, to any person obtaining a copy",
        "dies ist eine öffentliche lizenz: GNU  General\nPublic\tLicense.", "the apache licence and the mit licence under licence file",
    ]


def rows_of(df):
    return sorted([
        (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, [(d.start, d.end, d.rule) for d in r.detections])
        for r in df.collect()
    ], key=str)


def test_notices_like_all_rules_without_gates(spark):
    docs = list(enumerate(notices()))
    found = rows_of(license_scan.scan(plain.small(spark, docs)))
    assert found == sorted([(i, *expected(t)) for i, t in docs], key=str)
    assert sum(bool(r[6]) for r in found) >= 50


def test_awkward_documents(spark):
    rows = [(r[0], r[1]) for r in plain.awkward()]
    assert rows_of(license_scan.scan(plain.frame(spark))) == sorted([(i, *expected(t)) for i, t in rows], key=str)


def test_registered_query(spark):
    table = pq.read_table(f"{SF}/documents.parquet")
    want = sorted([(i, *expected(t)[:-1]) for i, t in zip(table["doc_id"].to_pylist(), table["text"].to_pylist())])
    got = sorted(tuple(r) for r in license_scan.op8_license_scan(spark, SF).collect())
    assert got == want


def test_hundreds_of_rules_and_no_python(spark):
    assert len(rules()) > 200 and len({r[0] for r in rules()}) == len(rules())
    plan = license_scan.scan(plain.frame(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "MapIn", "Exchange"))


def test_empty_table(spark):
    assert license_scan.scan(plain.frame(spark, [])).count() == 0


def test_a_megabyte_of_notices(spark):
    """Work must not grow with the square of the matches of a text; places stay exact."""
    n = 80_000
    row = license_scan.scan(spark.createDataFrame([(1, "mit license " * n)], "doc_id bigint, text string")).collect()[0]
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["labels"]) == (2 * n, n, 0, 2 * n - 2, "mit")
    assert [d["start"] for d in row["detections"]] == list(range(0, 12 * n, 12))


def test_sums_before_by_blocks(spark):
    for n in (0, 1, 2, 3, 10, 101):
        df = spark.range(1).select(F.expr(f"transform(filter(sequence(0, {n}), i -> i < {n}), i -> i * 7 % 5)").alias("v"))
        values = [i * 7 % 5 for i in range(n)]
        row = df.select(license_scan._before(F.col("v"), lambda x, y: x + y).alias("s"), license_scan._before(F.col("v"), F.greatest).alias("m")).first()
        assert row["s"] == [sum(values[:i]) for i in range(n)] and row["m"] == [max([0, *values[:i]]) for i in range(n)]
