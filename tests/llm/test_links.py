"""Operators that link rows: neighbours, SimHash, URLs, passages, quotes, and the pipeline."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest
import xxhash
from conftest import rows
from pyspark.sql import functions as F

import corpus_pipeline
from understory.llm import nearest, passages, quotes, simhash, urls

# nearest neighbours


def vectors(spark, x, ids=None):
    data = [(int(i), None if v is None else [None if c is None else float(c) for c in v], 1) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("score", F.lit("clash")).withColumn("cell", F.lit(0))


@pytest.mark.parametrize("how", [nearest.Projection(), nearest.Projection(cell_rows=60, block=2, leaf=8)])
def test_neighbours_recall(spark, how):
    x = np.random.default_rng(0).standard_normal((600, 24)).astype(np.float32)
    got = collections.defaultdict(list)
    for r in nearest.search(vectors(spark, x), every=20, how=how).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = 0
    for q in range(0, 600, 20):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.lexsort((np.arange(600), d))[:10].tolist()) & {v for v, _ in got[q]})
        assert len(got[q]) == 10 and all(s == pytest.approx(d[v], abs=1e-12) for v, s in got[q]) and got[q] == sorted(got[q], key=lambda p: (p[1], p[0]))
    assert hit / 300 >= 0.95


def test_equal_vectors_tie_to_smaller_ids(spark):
    x = [[1.0, 0.0]] * 200 + [[0.0, 1.0]] * 3
    got = [r.vec_id for r in nearest.search(vectors(spark, x), how=nearest.Projection(cell_rows=50)).where("query_id = 100").orderBy("rank").collect()]
    assert got == list(range(10))


def test_odd_vectors_take_no_part(spark):
    x = [[1, 2], None, [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [1, 2, 3], [1, 3]]
    assert rows(nearest.search(vectors(spark, x)), "query_id", "rank", "vec_id") == [(0, 1, 7)]
    assert nearest.search(vectors(spark, [])).count() == 0
    assert nearest.search(vectors(spark, [[1, 2]])).count() == 0


# SimHash


def brute_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [x for x in w.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_by_brute_force():
    r = random.Random(0)
    for _ in range(300):
        t = "".join(r.choice(["A", "b", "É", " ", "  ", "\n", "\xa0", "cd", "\t"]) for _ in range(r.randint(0, 60)))
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def test_spark_hashes_agree(spark):
    assert spark.sql("select xxhash64('a b c') h").first().h == np.uint64(xxhash.xxh64_intdigest("a b c", 42)).astype(np.int64)


def flipped(fp, bits):
    for b in bits:
        fp ^= 1 << b
    return fp


def test_golay_keys_meet_within_reach():
    r = random.Random(1)
    x = [r.getrandbits(64) for _ in range(3000)]
    y = [flipped(v, r.sample(range(64), i % 3)) for i, v in enumerate(x)]
    keys = []
    for fps in (x, y):
        at, key = simhash.fuzzy_keys(np.array(fps, np.uint64).view(np.int64))
        own = collections.defaultdict(set)
        for a, k in zip(at.tolist(), key.tolist(), strict=True):
            own[a].add(k)
        keys.append(own)
    assert all(keys[0][i] & keys[1][i] for i in range(len(x)))


@pytest.mark.parametrize("bucket", [2, 256])
def test_links_by_brute_force(spark, bucket):
    r = random.Random(2)
    fps = set()
    for _ in range(25):
        base = r.getrandbits(64)
        fps |= {flipped(base, r.sample(range(64), r.randint(0, 3))) for _ in range(12)}
    fps = sorted(np.array(list(fps), np.uint64).view(np.int64).tolist())
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 2:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = dict(rows(simhash.components(simhash.linked(spark.createDataFrame([(f,) for f in fps], "fp long"), bucket), "a", "b")))
    assert all(got.get(f, f) == find(f) for f in fps)


def documents(spark, texts, ids=None):
    data = [(i, t, "en", f"s{k % 2}", len(t or "")) for k, (i, t) in enumerate(zip(ids or range(len(texts)), texts, strict=True))]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in ("fp", "root", "component_id", "least", "start", "class", "_n")})


def test_near_duplicates(spark):
    texts = ["The quick brown fox jumps", None, "the  QUICK brown\nfox jumps", "", "something else here now", "x"]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(documents(spark, texts)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 4, 5: 5}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    kept = simhash.keep_one(documents(spark, texts))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 4, 5] and kept.columns == documents(spark, texts).columns


def test_repeated_ids_give_one_row(spark):
    kept = simhash.keep_one(documents(spark, ["a b c", "a b c", "d e f", "a b c"], ids=[3, 3, 5, 9]))
    assert sorted(r.doc_id for r in kept.collect()) == [3, 5]


# URLs

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


def pages(spark, found):
    return spark.createDataFrame(found, "page_id long, url string").withColumns({c: F.lit("clash") for c in ("host", "rule", "html", "confidence")})


def marks(spark, found):
    return spark.createDataFrame(found, "doc_id long, quality int, toxic int")


def test_hosts_paths_and_rules(spark):
    given = {
        "HTTP://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://x.net/de": ("x.net", "/de", "net/", "block"),
        "http://net": ("net", "", None, "allow"),
        "http://badnet/de/": ("badnet", "/de/", None, "allow"),
        "http://example.com/de/?a": ("example.com", "/de/", "example.com/de/", "block"),
        "ftp://x.fr.org/fr/1": ("x.fr.org", "/fr/1", "org/fr/", "allow"),
        "a://b://net/": ("b:", "//net/", None, "allow"),
        "http://É.net?x/y": ("É.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    df = pages(spark, list(enumerate(given)) * 2)
    got = rows(urls.judge(df, marks(spark, []), RULES), "page_id", "host", "path", "rule", "verdict")
    assert got == sorted([(i, *v) for i, v in enumerate(given.values())] * 2, key=str)
    assert urls.judge(pages(spark, []), marks(spark, [(1, 0, 1)]), RULES).count() == 0


def test_mined_rules_block_what_labels_say(spark):
    spam = [(i, f"http://spam{i % 7}.example.org/casino/{i}") for i in range(60)]
    good = [(100 + i, f"http://good{i % 9}.example.org/news/{i}") for i in range(120)]
    held_out = [(500, "http://new.example.org/casino/9"), (501, "http://new.example.org/news/9")]
    labels = marks(spark, [(i, 0, 1) for i, _ in spam] + [(i, 1, 0) for i, _ in good] + [(100, None, None)])
    got = {r.page_id: r.verdict for r in urls.judge(pages(spark, spam + good + held_out), labels, RULES).collect()}
    assert got[500] == "block" and got[501] == "allow" and all(got[i] == "block" for i, _ in spam) and all(got[i] == "allow" for i, _ in good)


def test_mining_by_counts(spark):
    spam = [(i, f"http://a.example.org/{'x' if i % 2 else 'y'}/p") for i in range(40)]
    rest = [(100 + i, f"http://a.example.org/{'x' if i % 2 else 'z'}/q") for i in range(60)]
    rules = urls.mine(spark.createDataFrame(spam + rest, "id long, url string"), spark.createDataFrame([(i, True) for i, _ in spam] + [(i, False) for i, _ in rest], "id long, bad boolean"))
    found = {tuple(r.antecedent) for r in rules.collect()}
    assert ("path:p",) in found and ("path:y",) in found and not any("path:p" in a and len(a) > 1 for a in found)


# passages


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(n))


def test_paragraphs_and_passages(spark):
    long = words(99, 120)
    near = long.split()
    near[60] = "changed"
    inside = words(7, 60)
    texts = [
        words(1, 30) + "\n" + long,
        " ".join(near) + "\n" + words(2, 40),
        words(3, 80) + " " + inside + " " + words(4, 50),
        words(5, 33) + " " + inside + " " + words(6, 71),
        words(8, 200),
        "short line\n" * 50,
        None,
        "",
        words(8, 200),
    ]
    got = passages.repeated(documents(spark, texts)).collect()
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add((r.kind, r.cluster_id, r.removed))
    assert ("paragraph", 0, False) in by[0] and ("paragraph", 0, True) in by[1]
    assert {k for k, _, _ in by[2]} == {"passage"} and ("passage", 2, True) in by[3]
    assert ("paragraph", 4, True) in by[8] and ("paragraph", 4, False) in by[4]
    assert not by[5] and not by[6] and not by[7]
    spans = [(r.start, r.stop) for r in got if r.doc_id == 2]
    assert all(80 <= a and b <= 140 for a, b in spans)
    assert passages.repeated(documents(spark, [])).count() == 0


def test_passages_recall_and_precision(spark):
    shared = [words(1000 + i, 52 + i % 30) for i in range(20)]
    texts = [words(i, 100 + i) + " " + shared[i % 20] + " " + words(5000 + i, 90) for i in range(60)] + [words(9000 + i, 250) for i in range(40)]
    hit = {r.doc_id for r in passages.repeated(documents(spark, texts)).collect()}
    assert len(hit & set(range(60))) >= 57 and not hit & set(range(60, 100))


def test_similar_lines_by_brute_force(spark):
    r = random.Random(4)
    lines = []
    for i in range(12):
        base = words(i, 60).split()
        for _ in range(6):
            w = list(base)
            for k in r.sample(range(60), r.randint(0, 4)):
                w[k] = f"z{r.randint(0, 99)}"
            lines.append(" ".join(w))
    lines = sorted(set(lines))
    sets = [passages.shingle_set(x, 5) for x in lines]
    edges = [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8]
    want = len({frozenset(e) for e in edges})
    for group in (512, 3):
        how = passages.Passages(group=group, recall=0.999999)
        docs = documents(spark, lines)
        got = dict(rows(passages.components(passages.similar_classes(docs, passages.paragraph_rows(docs, how), how), "a", "b")))
        cls = [int(np.uint64(xxhash.xxh64_intdigest(x.encode(), 42)).astype(np.int64)) for x in lines]
        root = list(range(len(lines)))
        for _ in lines:
            for i, j in edges:
                root[i] = root[j] = min(root[i], root[j])
        name = {c: got.get(c, c) for c in cls}
        assert want and all((root[i] == root[j]) == (name[cls[i]] == name[cls[j]]) for i in range(len(lines)) for j in range(i))


# quotes


def chat(spark, found):
    return spark.createDataFrame(found, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in ("own", "reply_to", "source", "_row", "level")})


def test_quotes(spark):
    found = [
        (1, 0, "u", "Hello there.\nHow are  you?"), (1, 1, "a", "On Monday X wrote:\n> how are you?\nFine thanks.\nLots to do"), (1, 2, "u", "no quote"), (1, 3, "a", "> > How are you?\n> lots to do\nok"),
        (1, 4, "u", "> hello THERE.\nyes"), (2, 0, "u", None), (2, 1, "a", "> never said\nx"), (3, 5, "u", ""), (None, 1, "u", "> a"), (4, 0, "u", "echo"), (4, 0, "u", "echo"), (4, 1, "a", ">echo"),
    ]
    got = {(r.conv_id, r.turn): (r.reply_to, r.n_quoted, r.n_linked, r.text) for r in quotes.link(chat(spark, found)).collect()}
    assert got[1, 0] == (None, 0, 0, "Hello there.\nHow are  you?")
    assert got[1, 1] == (0, 1, 1, "Fine thanks.\nLots to do")
    assert got[1, 2] == (1, 0, 0, "no quote")
    assert got[1, 3] == (1, 2, 2, "ok")
    assert got[1, 4] == (0, 1, 1, "yes")
    assert got[2, 0] == (None, 0, 0, None) and got[2, 1] == (0, 1, 0, "x") and got[3, 5] == (None, 0, 0, "") and got[4, 1] == (0, 1, 1, "")
    assert quotes.link(chat(spark, found)).count() == len(found) and quotes.link(chat(spark, [])).count() == 0


def test_quotes_by_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    r, found = random.Random(3), []
    for c in range(60):
        for t in range(r.randint(1, 8)):
            said = [r.choice(["alpha beta", "Gamma  delta", "eps", "common line", f"x{r.randint(0, 30)}", ""]) for _ in range(r.randint(0, 4))]
            quoted = [r.choice([">", "> ", "> > ", ">>"]) + r.choice(["ALPHA beta", "gamma delta", "eps", "common line", "nothing"]) for _ in range(r.choice([0, 0, 1, 2, 3]))]
            head = [r.choice(["On Monday X wrote:", "Y a écrit :"])] if quoted and r.random() < 0.5 else []
            found.append((c, t, "u", None if r.random() < 0.1 else "\n".join(head + quoted + said)))
            found += found[-1:] if r.random() < 0.1 else []
    names = ["conv_id", "turn", "role", "reply_to", "n_quoted", "n_linked", "text"]
    got = [tuple(x) for x in quotes.link(chat(spark, found)).select(names).collect()]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", found)
    want = con.execute(f"SELECT {', '.join(names)} FROM ({quotes.ORACLE})").fetchall()
    assert sorted(map(str, got)) == sorted(map(str, want)) and sum(x[5] for x in got) > 50


def test_reply_order_follows_parents(spark):
    found = [(1, t, "u", f"line {t}\nmore {t}" + (f"\n> line {t // 3}" if t % 4 == 0 and t else "")) for t in range(40)]
    seen = set()
    for r in quotes.link(chat(spark, found)).collect():
        assert r.reply_to is None or r.reply_to in seen
        seen.add(r.turn)
    assert len(seen) == 40


# pipeline


def test_pipeline_stages(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    good = [words(i, 90 + i) for i in range(30)]
    texts = [*good, good[3], "too short", None, words(50, 80) + ' token = "e7fbfec6a80404dc513b99d3fdbf2a6e53400638"']
    df = documents(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    docs, ids = df, None
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        back = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert back.columns == df.columns
            docs = back
        if name == "quality":
            assert {r.doc_id for r in back.collect()} == {*range(31), 33}
        if name == "near_duplicates":
            ids = {r.doc_id for r in back.collect()}
            assert ids == {*range(30), 33}
        if name == "secrets":
            assert back.where("text like '%e7fbfec6a8%'").count() == 0 and back.count() == 31
        if name == "mixing":
            assert {r.doc_id for r in back.collect()} <= ids
    assert back.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
    df.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == back.count()
