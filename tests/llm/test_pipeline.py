"""The stages of the corpus pipeline against plain Python, each on what the one before it kept."""

import re

import pytest

import corpus_pipeline
from gridtally.llm import decontaminate, minhash, quality, toxicity
from gridtally.llm.common import stored, table

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, width=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} - {()}


def first_of_groups(rows):
    """Ids of the rows that stay: the smallest of each group reachable over links of four fifths."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i for i in root if find(i) == i}


def test_stages_equal_plain_python(spark):
    docs, kept = table(spark, SF, "documents"), {}
    labels = table(spark, SF, "labels")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF), name)
        rows = {r["doc_id"]: r["text"] for r in before.select("doc_id", "text").collect()}
        kept[name] = len(rows)
        if name == "packing":
            lengths = {}
            for r in docs.collect():
                lengths[r["doc_id"]] = lengths.get(r["doc_id"], 0) + r["length"]
                assert r["offset"] + r["length"] <= 4096
            assert lengths == {r["doc_id"]: r["doc_tokens"] for r in docs.collect()} and set(lengths) == set(rows)
            continue
        assert docs.schema == before.schema
        got = {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "quality":
            want = {r["doc_id"] for r in quality.quality_scores(before, labels).where("predicted = 1").collect()}
        elif name == "toxicity":
            want = {r["doc_id"] for r in toxicity.toxicity_scores(before, labels).where("predicted = 0").collect()}
        elif name == "near_dedup":
            want = first_of_groups(list(rows.items()))
        else:
            items = [shingles(r["text"]) for r in table(spark, SF, "benchmark").collect()]
            want = {i for i, t in rows.items() if not any(q and 100 * len(q & shingles(t)) >= 80 * len(q) for q in items)}
        assert got == want, name
    assert kept["quality"] > kept["toxicity"] > kept["near_dedup"] > 0


A = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
B = "red orange yellow green blue violet black white grey brown pink beige gold silver bronze copper"


@pytest.fixture(scope="module")
def shared_ids(spark):
    rows = [(1, A), (1, B), (5, A + " more"), (6, B + " more"), (7, B.upper()), (1, A), (None, A), (8, None), (8, None)]
    return spark.createDataFrame([(i, t, 40 + n, 50 + n, "x", "y") for n, (i, t) in enumerate(rows)], "doc_id long, text string, _row long, _kept_id long, _bad_id string, _bad_mark string")


def test_rows_that_share_an_id_are_judged_by_their_own_text(shared_ids):
    for _ in range(2):
        got = minhash.drop_near_duplicates(shared_ids).collect()
        assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted([(1, A), (1, B), (-1, A), (8, ""), (8, "")])
        assert all(r["_row"] == r["_kept_id"] - 10 for r in got) and shared_ids.columns == list(got[0].asDict())


def test_columns_of_the_user_survive_decontamination(spark, shared_ids):
    items = spark.createDataFrame([(1, B)], "item_id long, text string")
    got = decontaminate.drop_contaminated(shared_ids, items).collect()
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in got) == sorted([(1, A), (1, A), (5, A + " more"), (-1, A), (8, ""), (8, "")])
    assert all(r["_row"] == r["_kept_id"] - 10 and (r["_bad_id"], r["_bad_mark"]) == ("x", "y") for r in got)
