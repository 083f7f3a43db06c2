"""The operators on Spark tables: brute force on small ones, odd rows, empty tables, clashing columns, the pipeline."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from glyphreel.llm import bpe, decontaminate, htmltext, langid, media, pii, queries, simhash, suffixes, toxicity, urlrules
from glyphreel.llm.common import held_out
from tests.llm.test_single import brute_repeats, slow_fingerprint

DATA = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None), (2, ""), (3, "   "), (4, "a"), (5, "word " * 4000), (6, "a"), (6, "a"), (None, "no id here"), (7, "é ñ 😀"), (8, "x" * 20_000)]
#: Names that operators use themselves.
CLASH = ("score", "predicted", "fp", "block", "ord", "n", "label", "spans", "digest", "q", "kind", "_label", "root", "node", "_gone", "Token_IDs", "hash", "least", "packed", "_place")


def odd_docs(spark):
    df = spark.createDataFrame([(i, t, None if i == 4 else "en", None, len(t) if t else None) for i, t in ODD], DOC)
    for c in CLASH:
        df = df.withColumn(c, F.lit(1))
    return df


@pytest.fixture(scope="module")
def odd_dir(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("odd")
    odd_docs(spark).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(1, 1, 1), (2, 0, 0), (None, 1, 1), (5, None, None), (8, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, None, None), (2, "", ""), (3, "x://a.net/é?q", "<p>hi there, all"), (3, "x://a.net/é?q", "<p>hi there, all"), (4, "http://B.Example.NET/en/", "<div>" * 500)], "page_id long, url string, html string").withColumn("tokens", F.lit(1)).withColumn("verdict", F.lit(1)).write.parquet(f"{base}/pages.parquet")
    spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six")], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return str(base)


@pytest.fixture(scope="module")
def empty_dir(spark, odd_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("empty")
    for t in ("documents", "labels", "pages", "benchmark"):
        spark.read.parquet(f"{odd_dir}/{t}.parquet").limit(0).write.parquet(f"{base}/{t}.parquet")
    return str(base)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_and_empty_tables(spark, odd_dir, empty_dir, name):
    rows = queries.QUERIES[name](spark, odd_dir).collect()
    n = {"op2": 5, "op3": 0, "op9": 5}.get(name.split("_")[0], len(ODD))
    assert len(rows) == n
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


def test_pipeline_odd_and_empty(spark, odd_dir, empty_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, odd_dir).columns == docs.columns, name
    kept = corpus_pipeline.run(spark, odd_dir)
    # of the three texts without words one stays, of the rows "a" the first
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 4, 5, 7, 8]
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)


def test_held_out(spark):
    import zlib

    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_toxicity_accuracy(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op1_toxicity(spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n[0, 0] / (n[0, 0] + n.get((0, 1), 0)) > 0.97 and n[1, 1] / (n[1, 1] + n.get((1, 0), 0)) > 0.6


def test_language_accuracy(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = langid.op5_langid(spark, d).where("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert got.where("lang = lang_pred").count() / got.count() > 0.98


def test_url_rules(spark):
    pages = spark.createDataFrame(
        [(1, "HTTP://A.B.NET?x=1"), (2, "http://Example.NET/en/x#y"), (3, "http://notexample.net/en/"), (4, "x://org/fr/é"), (5, "http://x.example.com/de"), (6, "http://net/"), (7, "http://example.com/de/?q"), (8, "http://x.example.net/english")],
        "page_id long, url string",
    )
    got = {r.page_id: (r.host, r.path, r.rule) for r in urlrules.parsed(pages, urlrules.RULES).collect()}
    assert got == {1: ("a.b.net", "", None), 2: ("example.net", "/en/x", "example.net/en/"), 3: ("notexample.net", "/en/", "net/"), 4: ("org", "/fr/é", "org/fr/"), 5: ("x.example.com", "/de", None), 6: ("net", "/", "net/"), 7: ("example.com", "/de/", "example.com/de/"), 8: ("x.example.net", "/english", "net/")}


def test_mined_rules_by_brute_force(spark):
    rows = urlrules.parsed(spark.read.parquet(f"{DATA}/pages.parquet"), urlrules.RULES).withColumn("tokens", urlrules.url_tokens())
    labelled = rows.where("ruled is not null")
    data = [(frozenset(r.tokens), r.ruled) for r in labelled.collect()]
    least, support, confidence = 0.1, collections.Counter(), collections.Counter()
    assert max(len(tokens) for tokens, _ in data) <= 8
    share = collections.Counter(v for _, v in data)
    for tokens, verdict in data:
        for k in range(1, len(tokens) + 1):
            for c in itertools.combinations(sorted(tokens), k):
                support[c] += 1
                confidence[c, verdict] += 1
    want = {}
    for (c, v), n in confidence.items():
        if n >= least * len(data) and n / support[c] >= max(urlrules.MIN_CONFIDENCE, urlrules.MIN_LIFT * share[v] / len(data)):
            want[c, v] = n / support[c]
    want = {(c, v): p for (c, v), p in want.items() if not any((c[:i] + c[i + 1 :], v) in want and want[c[:i] + c[i + 1 :], v] >= p for i in range(len(c)) if len(c) > 1)}
    got = {(tuple(r.tokens), r.verdict): r.confidence for r in urlrules.mine(labelled, least).collect()}
    assert got == pytest.approx(want)


def test_url_filter_whole(spark):
    got = urlrules.judge(spark.read.parquet(f"{DATA}/pages.parquet"))
    rows = got.collect()
    assert len(rows) == 50 and {r.verdict for r in rows} <= {"allow", "block"}
    want = dict(urlrules.RULES)
    assert all(r.verdict == want[r.rule] for r in rows if r.rule)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_by_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA), con.sql(queries.ORACLE_SQL[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)

    def rows(found, have):
        return sorted((tuple(r[have.index(c)] for c in cols) for r in found), key=repr)

    assert rows(map(tuple, got.collect()), got.columns) == rows(want.fetchall(), want.columns)


def test_leaks(spark):
    items = [(i, " ".join(f"w{i}x{k}" for k in range(20))) for i in range(5)]
    texts = ["nothing to see here at all", "pre " + items[2][1] + " post", " ".join(items[0][1].split()[10:] + items[0][1].split()[:10]), items[1][1][: len(items[1][1]) // 2], None, items[3][1] + " and " + items[4][1].upper()]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs_of(spark, texts), bench).collect()}
    assert got == {(1, 2), (2, 0), (5, 3), (5, 4)}


@pytest.mark.parametrize("max_shard", [simhash.MAX_SHARD, 3])
def test_simhash_components(spark, monkeypatch, max_shard):
    r = random.Random(5)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta".split()) + str(r.randrange(9)) for _ in range(300)) for _ in range(12)]
    texts = []
    for _ in range(150):
        w = r.choice(base).split()
        for _ in range(r.randint(0, 2)):
            w[r.randrange(len(w))] = "new" + str(r.randrange(5))
        texts.append(" ".join(w))
    texts += ["", None, " ", "a b", "a b"]
    monkeypatch.setattr(simhash.links, "__defaults__", (simhash.RADIUS, max_shard))
    got = {x.doc_id: x for x in simhash.grouped(spark, docs_of(spark, texts)).collect()}
    fp = [slow_fingerprint(t) for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        if (fp[i] ^ fp[j]).bit_count() <= 2:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    assert all(got[i].fp == simhash.signed(fp[i]) and got[i].component_id == top(i) for i in range(len(texts)))


def test_components_of_paths(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100 + i, 100) for i in range(1, 30)] + [(200, 200)]
    r.shuffle(edges)
    got = {x.node: x.root for x in simhash.components(spark, spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in range(100, 130)}


def test_components_that_do_not_settle(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)], "u long, v long")
    with pytest.raises(RuntimeError):
        simhash.components(spark, edges, rounds=2)


def test_near_copies(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in text.items() for w in [simhash.words_of(t)]}
    share = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(text), 2)}
    got = {r.node: r.root for r in simhash.near_copies(spark, docs).collect()}
    group = lambda i: got.get(i, i)
    assert all(group(a) == group(b) for (a, b), s in share.items() if s >= 0.85)
    close = collections.defaultdict(set)
    for (a, b), s in share.items():
        if s >= 0.7:
            close[a].add(b)
            close[b].add(a)
    assert all(close[i] for i in got)  # nothing goes that has no near copy


def links_of(spark, pairs):
    """For each pair of texts, whether near_copies puts it together (and nothing else)."""
    root = {x.node: x.root for x in simhash.near_copies(spark, docs_of(spark, [t for p in pairs for t in p])).collect()}
    assert all(k == v + 1 and v % 2 == 0 for k, v in root.items())
    return [2 * i + 1 in root for i in range(len(pairs))]


def test_near_copies_at_the_bound(spark):
    """400 shared shingles of 500 (0.8) are a near copy, of 502 not: sets larger than the sketch are counted whole."""
    pairs = []
    for i in range(120):
        common, tail = " ".join(f"c{i}x{k}" for k in range(404)), 50 + i % 2
        pairs.append(tuple(common + "".join(f" {side}{i}x{k}" for k in range(tail)) for side in "ab"))
    assert links_of(spark, pairs) == [i % 2 == 0 for i in range(120)]


def test_near_copies_of_repeated_lines(spark):
    """A line many times over turns the fingerprint of all shingles, but not the set; short texts of 4 shingles of 5."""
    pairs = []
    for i in range(40):
        text, line = (" ".join(f"{c}{i}x{k}" for k in range(n)) for c, n in (("t", 200), ("l", 12)))
        pairs.append((text, " ".join([text, *[line] * (10 + i)])))
    for i in range(400):
        text = " ".join(f"s{i}x{k}" for k in range(8))
        pairs.append((text, text + " more"))
    assert all(links_of(spark, pairs))


@pytest.mark.parametrize("piece", [simhash.PIECE, 16])
def test_near_copies_of_large_shards(spark, monkeypatch, piece):
    """Large groups of near copies, chains of them and a passage that many other texts share, dealt in small pieces:
    every group as by comparing all pairs."""
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "LEADERS", 4, raising=False)
    r = random.Random(11)
    words = lambda tag, n: [f"{tag}{r.randrange(10**6)}" for _ in range(n)]
    lists = []
    for c in range(2):
        base = words(f"b{c}x", 150)
        for _ in range(90):  # most are further than 0.8 from each other, fewer from the group
            w = list(base)
            for _ in range(r.randint(0, 5)):
                w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
            lists.append(w)
    chain = words("k", 150)
    for _ in range(60):
        chain = list(chain)
        for _ in range(r.randint(1, 4)):
            chain[r.randrange(len(chain))] = f"m{r.randrange(10**6)}"
        lists.append(chain)
    passage = words("p", 60)
    lists += [words("q", r.randint(5, 60)) + passage + words("z", r.randint(5, 60)) for _ in range(120)]
    r.shuffle(lists)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in lists]
    root = list(range(len(lists)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(lists)), 2):
        both = len(sets[i] & sets[j])
        if both and both / (len(sets[i]) + len(sets[j]) - both) >= 0.8:
            a, b = sorted((top(i), top(j)))
            root[b] = a
    want = {i: top(i) for i in range(len(lists)) if top(i) != i}
    got = {x.node: x.root for x in simhash.near_copies(spark, docs_of(spark, [" ".join(w) for w in lists])).collect()}
    assert got == want


@pytest.mark.parametrize("bucket_text", [1 << 30, 3000, 100])
def test_repeats(spark, bucket_text):
    r = random.Random(7)
    base = ["".join(r.choice("abcdé \n") for _ in range(r.randint(0, 300))) for _ in range(20)] + ["a" * 300, "ab" * 100, ""]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(r.randint(0, 4)):
            b = r.choice(base)
            at = r.randint(0, max(0, len(b) - 1))
            parts.append(b[at : at + r.choice((30, 49, 50, 51, 60, 200))])
        texts.append("".join(parts))
    texts[60:63] = texts[10:13]
    got = {x.doc_id: tuple(x)[1:] for x in suffixes.remove_repeats(spark, docs_of(spark, texts), bucket_text).collect()}
    assert got == brute_repeats([(i, t.encode()) for i, t in enumerate(texts)])


def test_repeats_of_a_long_copy(spark):
    r = random.Random(8)
    long = "".join(chr(97 + r.randrange(26)) for _ in range(6000))
    texts = [long, long[:2500] + "#" + long[2500:4000] + "%" * 60, "x" * 49 + long[1000:1050], long]
    got = {x.doc_id: tuple(x)[1:] for x in suffixes.remove_repeats(spark, docs_of(spark, texts), 4000).collect()}
    assert got == brute_repeats([(i, t.encode()) for i, t in enumerate(texts)])


def test_repeats_of_odd_rows(spark):
    text = "".join(chr(97 + random.Random(3).randrange(26)) for _ in range(80))
    rows = [(None, text), (1, text), (1, text), (1, "#" + text), (2, text + "!"), (3, None), (None, "")]
    got = collections.Counter(tuple(r)[:3] for r in suffixes.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), 64).collect())
    assert got == collections.Counter([(None, 80, 80), (1, 80, 0), (1, 80, 0), (1, 81, 0), (2, 81, 80), (3, 0, 0), (None, 0, 0)])


def test_media_and_tokens(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    text = {r.doc_id: r.text.encode() for r in docs.collect()}
    for r in media.op6_media(spark, DATA).collect():
        t = text[r.doc_id]
        assert r.n_bytes == len(t) and r.payload_sha256 == hashlib.sha256(t + b"\0" * (r.payload_bytes - len(t))).hexdigest()
    for r in bpe.op10_bpe(spark, DATA).collect():
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id]).hexdigest()
    ids = bpe.encode_documents(docs, ["doc_id"])
    assert all(r.text.encode() == text[r.doc_id] for r in bpe.decode_ids(ids, ["doc_id"]).collect())


def test_pages_and_spans(spark):
    for r in htmltext.op9_html_text(spark, DATA).limit(20).collect():
        assert r.n_chars == len(r.text) > 0 and "©" not in r.text
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    for r in pii.op7_pii(spark, DATA).collect():
        base = pii.base_spans(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(pii.digest(base).encode()).hexdigest() and r.n_email + r.n_ip + r.n_card + r.n_phone == len(base)


def test_pipeline(spark):
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, DATA).collect()}
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    model = toxicity.train(spark, DATA)
    rate = model.rater()
    kept = {i: d for i, d in docs.items() if model.score(rate(d.text)[0]) < 0.5}
    gone = {r.node for r in simhash.near_copies(spark, spark.createDataFrame([(i, d.text) for i, d in kept.items()], "doc_id long, text string")).collect()}
    items = decontaminate.Items([(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()])
    kept = {i: d for i, d in kept.items() if i not in gone and not items.match(d.text, 0.8)}
    assert set(got) == set(kept)
    codec = bpe.codec()
    for i, r in got.items():
        assert r.text == pii.redact(docs[i].text) and r.n_chars == len(r.text) and codec.decode(r.token_ids).decode() == r.text


def test_texts_are_encoded_by_many_tasks(spark):
    from glyphreel.llm import queries

    # the table is one small file
    assert queries.bpe_round_trip(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
