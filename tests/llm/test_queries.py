import collections
import hashlib
import random
import re

import pytest

from tests.checking import SF, same
from tests.llm.test_operators import brute_components
from turnmill.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, Q.queries()[name], Q.oracle_sql()[name])


def test_pipeline_keeps_the_columns_and_all_stages_act(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before, counts = docs.columns, [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == before
        counts.append(docs.count())
    assert counts[0] > counts[1] == counts[2] > counts[3] >= counts[4]
    last = corpus_pipeline.run(spark, SF)
    assert last.count() == counts[4]
    assert last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def plain_lines(rows):
    """Lines of four words and more on two sites and more stay at their first place."""
    squeezed = lambda x: " ".join(re.split(r"[\x20\x09-\x0D]+", x)).strip(" ")
    places = collections.defaultdict(list)
    for r in rows:
        for pos, line in enumerate((r["text"] or "").split("\n")):
            if squeezed(line).count(" ") >= 3:
                places[squeezed(line)].append((r["doc_id"], pos, r["source"]))
    gone = {(d, p) for at in places.values() if len({s for *_, s in at}) > 1 for d, p, _ in sorted(at)[1:]}
    return [r | {"text": None if r["text"] is None else "\n".join(x for p, x in enumerate(r["text"].split("\n")) if (r["doc_id"], p) not in gone)} for r in rows]


def leaks(text, items):
    """Whether a window of an item's length has a bag of shingles that is similar enough."""
    w = (text or "").lower().split()
    bag = lambda x: collections.Counter(" ".join(x[i : i + 5]) for i in range(len(x) - 4))
    for item in items:
        b = bag(item)
        for s in range(max(1, len(w) - len(item) + 1)):
            a = bag(w[s : s + len(item)])
            if a and 100 * (a & b).total() >= 80 * (a | b).total():
                return True
    return False


def test_pipeline_is_that_of_plain_stages(spark, tmp_path):
    """All stages in a row against plain loops over a small corpus with nulls, copies, leaks, shared lines and toxic rows."""
    import corpus_pipeline

    rng = random.Random(23)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    bad, line, items = [f"insult{k}" for k in range(5)], "shared line of words " + prose(30), [prose(30), prose(45)]
    texts = [f"{prose(60)}\n{prose(20)}" for _ in range(110)]
    for k in range(0, 100, 5):
        texts[k] = f"{texts[k]} {' '.join(rng.sample(bad, 4))}"
    for k in range(1, 40, 4):
        texts[k] = f"{texts[k]}\n{line}"
    texts += [f"{texts[k]} more" for k in (2, 3, 4)] + [texts[6], f"{prose(9)} {items[0]} {prose(9)}", items[1], None, "", " "]
    table = [{"doc_id": i, "text": t, "lang": "en", "source": f"s{i % 3}", "n_chars": len(t or "")} for i, t in enumerate(texts)]
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([tuple(r.values()) for r in table], kinds).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int("insult" in (t or ""))) for i, t in enumerate(texts)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    rows = plain_lines([r for r in table if "insult" not in (r["text"] or "")])
    links = brute_components([r["text"] for r in rows])
    rows = [r for i, r in enumerate(rows) if links[i][1] == i]
    rows = [r for r in rows if not leaks(r["text"], [x.split() for x in items])]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    assert sorted((r.doc_id, r.text, r.n_chars) for r in docs.where("text IS NOT NULL").collect()) == sorted((r["doc_id"], r["text"], len(r["text"])) for r in rows if r["text"] is not None)
    out = {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert out == {r["doc_id"]: hashlib.sha256((r["text"] or "").encode()).hexdigest() for r in rows}


def test_pipeline_of_odd_and_empty_tables(spark, tmp_path):
    """Null ids, repeated ids with different texts, columns of its own names, no rows at all: no stage fails or loses a row."""
    import corpus_pipeline

    marks = "doc_id long, quality int, toxic int"
    kinds = "doc_id long, text string, lang string, source string, n_chars long, drop_at int, keep_id string, leak_id long, kind int"
    rows = [(None, "one text of some words here"), (None, "another one with other words in it"), (3, "a third text that shares its id"), (3, "with this fourth text here and there"), (4, None), (None, None), (5, "")]
    for name, some in (("odd", rows), ("empty", [])):
        sf = f"{tmp_path}/{name}"
        spark.createDataFrame([(i, t, None, None, None, 1, "x", 2, 3) for i, t in some], kinds).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(3, 1, 0)] if some else [], marks).write.parquet(f"{sf}/labels.parquet")
        spark.createDataFrame([(1, "an item of the benchmark that nothing holds"), (2, None)] if some else [], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        assert sorted((r.doc_id for r in corpus_pipeline.run(spark, sf).collect()), key=repr) == sorted((i for i, _ in some), key=repr)
