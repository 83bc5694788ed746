"""License scan: ordered signature rules over whole texts, with DataFrame functions only and without a shuffle.

1. A few plain strings decide whether a document is scanned at all.
2. Of the rules (see ``license_rules``), those run whose gate and keys are in the document. Each gives the places of all its matches.
3. Detections are sorted by start, longer first, then by rule order; one sweep drops every detection that lies inside
   an earlier one. So the longest wording wins, and of equal places the rule of highest priority.

Beside the rules, base phrases are found as runs of words: every place counts, and their labels always stay.

Null text counts as empty: no words, no labels, score 0. Repeated rows are judged each. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.license_rules import DOCUMENT_GATES, DOCUMENT_PATTERN, rules
from fleetlens.llm.session import documents
from fleetlens.llm.words import WORD, WORD_ANY_CASE, lower_az

# Phrase and label.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
PHRASE_WEIGHT = 0.5
_PLACE = "struct<start:int,back:int,rule:int,end:int>"


def _rule_array() -> Column:
    return F.array(*[
        F.struct(
            F.lit(i).alias("rule"), F.lit(gate).alias("gate"), F.array(*map(F.lit, keys)).alias("keys"), F.lit(pattern).alias("pattern")
        )
        for i, (_, _, gate, keys, pattern, _) in enumerate(rules())
    ])


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _before(values: Column, merge) -> Column:
    """For each of the values, 0 merged with all values before it.

    Appending copies an array, so values are taken in blocks of about the square root of their number: within blocks first, then over
    the blocks. The work grows with the power 1.5 of their number, and by few copies.
    """
    state = lambda: F.struct(F.lit(0).alias("all"), F.array().cast("array<int>").alias("before"))
    step = lambda a, x: F.struct(merge(a["all"], x).alias("all"), F.concat(a["before"], F.array(a["all"])).alias("before"))

    def by_blocks(v: Column) -> Column:
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(v))).cast("int"))
        return _let(F.struct(v.alias("v"), width.alias("w")), lambda x: _let(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.ceil(F.size(x["v"]) / x["w"]).cast("int")), lambda i: i * x["w"] < F.size(x["v"])),
                lambda i: F.aggregate(F.slice(x["v"], i * x["w"] + 1, x["w"]), state(), step),
            ),
            lambda blocks: F.flatten(F.zip_with(
                blocks, F.aggregate(blocks, state(), lambda a, block: step(a, block["all"]))["before"],
                lambda block, earlier: F.transform(block["before"], lambda y: merge(earlier, y)),
            )),
        ))

    return _let(values, by_blocks)


def _places(text: Column, rule: Column) -> Column:
    """Start, minus the length, rule and end of each match: lengths of the matches and of the texts between them, added up."""
    between = F.split(text, rule["pattern"], -1)
    matches = F.regexp_extract_all(text, rule["pattern"], F.lit(0))
    lengths = F.filter(
        F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"))), lambda x: x["m"].isNotNull())
    return _let(lengths, lambda found: F.zip_with(
        found, _before(F.transform(found, lambda x: x["b"] + x["m"]), lambda x, y: x + y),
        lambda x, at: F.struct(
            (at + x["b"]).alias("start"), (-x["m"]).alias("back"), rule["rule"].alias("rule"), (at + x["b"] + x["m"]).alias("end"),
        ),
    ))


def _outermost(places: Column) -> Column:
    """Of places sorted by start and falling length, those that do not lie inside an earlier one."""
    reached = _before(F.transform(places, lambda x: x["end"]), F.greatest)
    seen = F.zip_with(places, reached, lambda x, to: F.struct(x.alias("x"), to.alias("to")))
    return F.transform(F.filter(seen, lambda x: x["x"]["end"] > x["to"]), lambda x: x["x"])


def _phrase_starts(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    fits = lambda i: [F.get(words, i + j) == p for j, p in enumerate(parts)]

    def test(i: Column) -> Column:
        first, *rest = fits(i)
        for r in rest:
            first = first & r
        return first

    last = F.size(words) - len(parts)
    return F.when(last >= 0, F.filter(F.sequence(F.lit(0), last), test)).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    ``detections`` holds (start, end, rule, label, weight) in characters of the text. ``score`` is the largest weight of a
    detection, at least ``PHRASE_WEIGHT`` where a base phrase stands, else 0.
    """
    table = rules()
    none = F.array().cast(f"array<{_PLACE}>")
    read = docs.select(
        F.col(id_col).alias("doc_id"), lower_az(F.col(text_col)).alias("_low"),
        F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_ANY_CASE)).cast("long").alias("n_words"),
    )
    has = lambda word: F.contains("_low", F.lit(word))
    gate = F.col("_low").rlike(DOCUMENT_PATTERN)
    for word in DOCUMENT_GATES:
        gate = has(word) | gate
    phrase_gate = F.lit(False)
    for phrase, _ in PHRASES:
        every = F.lit(True)
        for word in phrase.split():
            every = every & has(word)
        phrase_gate = phrase_gate | every
    gated = read.select(
        "doc_id", "n_words", F.when(gate, F.col("_low")).alias("_low"),
        F.when(phrase_gate, F.regexp_extract_all("_low", F.lit(WORD), F.lit(0))).otherwise(F.array().cast("array<string>")).alias("_words"),
    )
    active = F.filter(
        _rule_array(),
        lambda r: F.contains(F.col("_low"), r["gate"]) & F.exists(r["keys"], lambda k: F.contains(F.col("_low"), k)),
    )
    found = F.flatten(F.transform(active, lambda r: _places(F.col("_low"), r)))
    placed = gated.select(
        "doc_id", "n_words", F.when(F.col("_low").isNotNull(), F.sort_array(found)).otherwise(none).alias("_places"),
        *[_phrase_starts(F.col("_words"), phrase).alias(f"_p{i}") for i, (phrase, _) in enumerate(PHRASES)],
    )
    names, labels, weights = (F.array(*map(F.lit, column)) for column in zip(*[(r[0], r[1], r[5]) for r in table]))
    starts = F.concat(*[F.col(f"_p{i}") for i in range(len(PHRASES))])
    base = F.array_compact(F.array(*[F.when(F.size(f"_p{i}") > 0, label) for i, (_, label) in enumerate(PHRASES)]))
    kept = placed.select("doc_id", "n_words", starts.alias("_starts"), base.alias("_base"), _outermost(F.col("_places")).alias("_kept"))
    detections = F.transform("_kept", lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.get(names, x["rule"]).alias("rule"),
        F.get(labels, x["rule"]).alias("label"), F.get(weights, x["rule"]).alias("weight"),
    ))
    kept = kept.select("doc_id", "n_words", "_starts", "_base", detections.alias("detections"))
    weight = F.array_max(F.transform("detections", lambda x: x["weight"]))
    floor = F.when(F.size("_starts") > 0, PHRASE_WEIGHT).otherwise(0.0)
    every = F.concat("_base", F.transform("detections", lambda x: x["label"]))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return kept.select(
        "doc_id", "n_words", F.size("_starts").cast("long").alias("n_base"),
        F.array_min("_starts").cast("long").alias("first_word"), F.array_max("_starts").cast("long").alias("last_word"),
        joined(F.col("_base")).alias("base_labels"), joined(every).alias("labels"),
        F.greatest(F.coalesce(weight, F.lit(0.0)), floor).alias("score"), "detections",
    )


def op8_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir)).drop("detections")


QUERIES = {"op8_license_scan": (op8_license_scan, None)}
