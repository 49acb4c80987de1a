"""Jaccard components, decontamination, personal data, neighbours, pages and the pipeline against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evolens.llm import decontamination, html_text, jaccard_join, neighbours, pii, queries
from evolens.llm.components import components

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_components(rows, words, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (name, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), name), name)
    return {(name, len(sets[i]), least[find(i)]) for i, (name, _) in enumerate(rows)}


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_jaccard(spark, docs, words, percent):
    draw = np.random.RandomState(3)
    base = [f"w{x}" for x in draw.randint(0, 10_000, 120)]
    near = []
    for i in range(150):
        copy = list(base)
        for k in draw.randint(0, 120, draw.randint(0, 5)):
            copy[k] = f"x{draw.randint(10_000)}"
        near.append((10_000 + i, " ".join(copy)))
    rows = [(r["doc_id"], r["text"]) for r in docs.limit(150).collect()] + near + [(20_000, None), (20_001, ""), (20_002, "a b"), (20_003, "A  b")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("component", F.lit(1)).withColumn("class", F.lit("x"))
    found = jaccard_join.similarity_components(table, words, percent)
    assert {tuple(r) for r in found.collect()} == brute_components(rows, words, percent)


def test_one_of_each_stays(spark, odd):
    kept = jaccard_join.keep_one_each(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 7, 8, None], key=str)
    assert jaccard_join.similarity_components(odd.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a bigint, b bigint")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


@pytest.mark.parametrize("block", [200_000, 40])
def test_decontamination(spark, folder, docs, block):
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    extra = spark.createDataFrame([(900, "re"), (901, None), (902, " .. "), (903, "É É")], "item_id bigint, text string")
    items = items.unionByName(extra)
    cut = {}
    for r in items.collect():
        w = WORD.findall((r["text"] or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)):
            if w:
                cut.setdefault(tuple(w[k : k + 10]), set()).add(r["item_id"])
    sizes = {len(w) for w in cut}
    table = docs.unionByName(docs.limit(2)).unionByName(docs.limit(3).withColumn("text", F.lit("x É é É É re")).withColumn("doc_id", F.lit(None).cast("bigint")))
    want = []
    for r in table.collect():
        w = WORD.findall((r["text"] or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in cut:
                    hit.update(range(k, k + n))
                    found |= cut[tuple(w[k : k + n])]
        want.append((r["doc_id"], len(w), len(hit), len(found), ",".join(sorted(map(str, found))), bool(hit)))
    got = [tuple(r) for r in decontamination.contamination(table, items, block=block).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontamination.drop_contaminated(table, items).count() == sum(not r[5] for r in want)
    assert decontamination.contamination(table, items.limit(0)).where("contaminated").count() == 0


BASE = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def passes(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def test_personal_data(spark, docs):
    tricky = [
        "a@b.c_d@e.f..x@y.z@q.r", "1.2.3.4.5 999.1.1.1 00000000000000000001.2.3.4", "4111 1111-1111 1111 9 41111111111111111111", "+1 (23) 456-78 90 +1 ",
        "é🙂 mail me: ü@x.yz né@ab.cd", "x" * 20_000 + "@", "a@" + "b." * 20_000 + "c", "1" * 20_000, None, "call (212) 555-0100 now",
    ]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + list(enumerate(tricky, 10**6))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("base", F.lit(0)).withColumn("spans", F.lit(0))
    found = pii.detect(table).select("doc_id", pii.joined(F.col("base")).alias("base"), F.size("spans").alias("n"), F.size("base").alias("m"))
    got = {r["doc_id"]: r for r in found.collect()}
    for name, text in rows:
        want = [f"{k}:{m.start()}:{m.end()}" for k, rule in BASE.items() for m in rule.finditer(text or "") if passes(k, m[0])]
        assert got[name]["base"] == ",".join(want), name
        assert got[name]["n"] >= got[name]["m"]
    hidden = pii.mask(table.where("doc_id < 1000000 or doc_id = 1000004"))
    assert hidden.columns == table.columns
    assert hidden.where(F.col("text").rlike(r"[a-z]@[a-z]")).count() == 0 and hidden.where(F.col("text").contains("[EMAIL]")).count() > 0


def test_reliabilities_stay_probabilities():
    likely = pii.reliabilities({"email:111": 50, "email:0--": 3, "card:1--": 1})
    assert likely["email:111"] > 0.9 > likely["email:0--"] and all(0 < p < 1 for p in likely.values())


def test_neighbours(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    odd = [(10_000, None), (10_100, []), (10_200, [0.0] * 64), (10_300, [float("nan")] * 64), (10_400, [None] * 64), (10_500, [1.0] * 3)]
    bad = spark.createDataFrame(odd, "vec_id bigint, embedding array<float>").withColumn("label", F.lit(0))
    found = neighbours.search(table.unionByName(bad), 10).collect()
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=float)) for r in table.collect()]
    ids, vectors = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    hits = total = 0
    for i, v in rows:
        if i % 10 == 0:
            d = np.sqrt(((vectors - v) ** 2).sum(1))
            d[ids == i] = np.inf
            true = set(ids[np.lexsort((ids, d))[:10]].tolist())
            mine = sorted((r for r in found if r["query_id"] == i), key=lambda r: r["rank"])
            assert [r["rank"] for r in mine] == list(range(1, 11)) and [r["score"] for r in mine] == sorted(r["score"] for r in mine)
            hits, total = hits + len(true & {r["vec_id"] for r in mine}), total + 10
    assert hits / total >= 0.9
    few = table.orderBy("vec_id").limit(4)
    assert neighbours.search(few, 1).count() == 12 and neighbours.search(table.limit(0), 1).count() == 0
    same = table.limit(30).withColumn("embedding", F.array(*[F.lit(1.0).cast("float")] * 4))
    assert neighbours.search(same, 1).count() == 300


def test_neighbours_do_not_depend_on_bins(spark, folder, monkeypatch):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    wide = sorted(map(tuple, neighbours.search(table, 10).collect()))
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    of, blocks = neighbours.bins(np.array([3, 0, 12, 2, 40, 0, 1]))
    assert of.tolist() == [0, 0, 0, 1, 2, 3, 3] and blocks.tolist() == [1, 1, 3, 1]
    assert sorted(map(tuple, neighbours.search(table, 10).collect())) == wide


def test_pages(spark, folder):
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op6_main_text_segment(spark, folder).collect()}
    import html

    for r in rows:
        inner = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", r["html"], re.S)[1])
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", " ", inner)).split())
        assert got[r["page_id"]]["text"] == want and got[r["page_id"]]["n_chars"] == len(want)
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    weights = html_text.train(pages)
    page = "<body><nav><a>Home</a></nav><div class='cookie-notice'>We use cookies here</div><main><h1>Big title</h1><p>one two three four five six seven" \
        "<aside>buy now</aside><p>eight &lt;b&gt; nine ten eleven twelve</p><div id=comments><p>nice post, thank you very much indeed</p></div></main></body>"  # fmt: skip
    assert html_text.extract(page, weights) == "Big title one two three four five six seven eight <b> nine ten eleven twelve"
    odd = spark.createDataFrame([(1, "u", None), (2, None, ""), (3, "u", "<p"), (4, "u", "plain")], "page_id bigint, url string, html string")
    assert [r["text"] for r in html_text.main_text(odd, weights).orderBy("page_id").collect()][:2] == ["", ""]


def test_pipeline(spark, folder, docs):
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, folder)
        assert after.columns == docs.columns, name
        before = after
    ids = {r["doc_id"] for r in before.collect()}
    found = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in found} == ids and 0 < len(ids) < docs.count()
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    left = decontamination.contamination(docs.where(F.col("doc_id").isin(list(ids))), items)
    assert left.where("contaminated").count() == 0
    assert all(hashlib.sha256(r["ids"]).hexdigest() == r["ids_sha256"] for r in found)


def test_other_texts_of_an_id_stay(spark):
    x, y, z = ([f"{k}{i}" for i in range(30)] for k in "xyz")
    near = " ".join(["changed", *z[1:]])
    rows = [
        (3, " ".join(x)), (7, " ".join(x)), (7, " ".join(y)),  # the other text of 7 is its own
        (13, " ".join(x[::-1])), (13, " ".join(z)), (12, near), (15, " ".join(x[::-1])),  # 13 goes for 12, but stands for 15
        (None, "one two three four five six"), (None, "one two three four five six"), (None, " ".join(x)), (None, ""), (None, None), (20, ""), (20, ""),
    ]
    kept = jaccard_join.keep_one_each(spark.createDataFrame(rows, "doc_id bigint, text string"))
    want = [rows[i] for i in (0, 2, 3, 5, 7, 10, 11, 12)]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


def test_texts_without_ids_link(spark):
    middle = [f"w{i}" for i in range(200)]
    left, right = ["l"] * 1 + middle[1:], middle[:-1] + ["r"]
    percent = 98  # left and right differ by two shingles on either side, each by one from the text without an id
    rows = [(1, " ".join(left)), (None, " ".join(middle)), (2, " ".join(right))]
    assert not jaccard_join.linked(*(jaccard_join.shingle_sets(pa.record_batch({"text": [rows[i][1]]}), 1)[0] for i in (0, 2)), percent + 1)
    found = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 1, percent + 1)
    assert {r["component_id"] for r in found.collect()} == {1}
