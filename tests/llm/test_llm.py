"""Training-data operators: edge rows, brute force, round trips."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

pytest.importorskip("popsight.llm")
from popsight.llm import chat, html, jaccard, lines, mixing, packing, quality, sharding, spotsigs, toxicity  # noqa: E402
from popsight.llm.components import connected_components  # noqa: E402

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, kept int, shard int, _row string"
WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 40


def prose(seed, n=120):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def lined(seed, n=12, words=10):
    return "\n".join(prose(f"{seed}-{i}", words) for i in range(n))


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empties, one very long text, exact copies, a repeated row, near copies, clashing columns."""
    base = prose("near", 300)
    near = base.replace(" ", "  ", 1).rsplit(" ", 3)[0] + " x y z"
    texts = {0: None, 1: "", 2: " \n\t", 3: "one", 4: "two words", 5: prose("long", 30000), 6: base, 7: base, 8: near,
             9: lined("a"), 10: "start\n" + lined("a") + "\nend", 11: prose("junk", 60), 12: "ümläut " * 30, 13: "one"}
    rows = [(i, t, None if i == 3 else "en", None if i == 4 else f"s{i % 2}", 0, 7, 8, "r") for i, t in texts.items()]
    rows += [rows[6], (None, base, "en", "s0", 0, 7, 8, "r"), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def ids(df, col="doc_id"):
    return sorted((r[0] for r in df.select(col).collect()), key=lambda x: (x is None, x))


def test_sharding(spark, edge, empty):
    keys = edge.select("doc_id", F.crc32(F.col("text").cast("binary")).alias("crc"))
    got = sharding.assign_shards(keys, ["doc_id"], 5).collect()
    assert len(got) == edge.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(5)]
    assert max(sizes) - min(sizes) <= 1
    assert sharding.assign_shards(empty.select("doc_id"), ["doc_id"], 5).count() == 0
    hot = spark.range(3000).select(F.when(F.col("id") < 1000, 1).otherwise(F.col("id")).alias("k"))
    sizes = [r[1] for r in sharding.assign_shards(hot, ["k"], 7).groupBy("shard").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) - min(sizes) <= 1


def test_sharding_splits_a_hot_key(spark, monkeypatch):
    """A null id on a third of the rows lies in one cell; its rows are ranked in buckets of their own."""
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 50)
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("k"), F.col("id").alias("v"))
    seen = []
    real = Window.partitionBy
    monkeypatch.setattr(sharding.Window, "partitionBy", staticmethod(lambda *c: (seen.append(c), real(*c))[1]))
    got = sharding.assign_shards(df, ["k"], 6, identity=["k", "v"])
    assert ("_arc", "_cell", "_b") in seen
    rows = got.collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert len(rows) == 6000 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len({r.v for r in rows}) == 6000


def test_op1_as_registered(spark, tmp_path):
    from popsight import llm
    rows = [(i, None if i % 40 == 0 else "ü" * (i % 30)) for i in range(400)] + [(None, "x"), (None, None), (7, "same"), (7, "same")]
    spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id bigint, text string, shard int, slot int").write.parquet(f"{tmp_path}/documents.parquet")
    df = llm.queries()["op1_bounded_ring_shards"](spark, str(tmp_path))
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    got = df.collect()
    want = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=str) == sorted(want, key=str)
    by = collections.defaultdict(list)
    for r in got:
        assert r.law == "rows" and 0 <= r.shard < 40 and r.grown_shard is None
        by[r.shard].append(r.slot)
    assert len(by) == 40 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1


@pytest.mark.parametrize("n", [0, 1, 150])
def test_op5_as_registered(spark, tmp_path, n):
    """Edited texts, digests and both likeness columns against brute force, from the fingerprints' own sets."""
    import hashlib
    from popsight import llm
    r = random.Random(n)
    rows = [(i * 7, None if i % 13 == 5 else "" if i % 13 == 6 else prose(i // 2, r.randint(1, 80)) + " ü😀" * (i % 3)) for i in range(n)]
    rows += [(-(1 << 63), "the smallest id of all")] * (n > 1)
    spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id bigint, text string, _next string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    df = llm.queries()["op5_spotsigs"](spark, str(tmp_path))
    assert df.dtypes == [("doc_id", "bigint"), ("n_chars", "bigint"), ("edited_sha256", "string"), ("fingerprint", "string"),
                         ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")]
    got = {x.doc_id: x for x in df.collect()}
    order = sorted(rows, key=lambda x: -x[0])
    assert len(got) == len(rows)

    def as_set(f):
        return {f[i:i + 16] for i in range(0, len(f), 16)}

    def near(a, b):
        return len(as_set(a) & as_set(b)) / len(as_set(a) | as_set(b))

    for k, (d, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)]
        third = len(t) // 3
        edited = t[:len(t) - third] + (after[1] or "")[:third]
        x = got[d]
        assert x.n_chars == len(t) and x.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert x.near_edited == pytest.approx(near(x.fingerprint, x.edited_fingerprint))
        assert x.near_next == pytest.approx(near(x.fingerprint, got[after[0]].fingerprint))
        assert (edited == t) <= (x.fingerprint == x.edited_fingerprint)
    same = collections.defaultdict(set)
    for d, t in rows:
        same[t or ""].add(got[d].fingerprint)
    assert all(len(v) == 1 for v in same.values())


def test_ring_moves_little():
    counts = {}
    for n in (20, 21):
        at, owners, cells = sharding.ring(n)
        arcs = [0] * len(at)
        home = {}
        for key in range(20_000):
            cell = zlib.crc32(str(key).encode()) % cells
            a = next((i for i, c in enumerate(at) if c >= cell), 0)
            arcs[a] += 1
            home[key] = (a, arcs[a] - 1)
        plan = collections.defaultdict(list)
        for a, lo, hi, s, _ in sharding.flow(arcs, owners, n, 1.25):
            plan[a].append((lo, hi, s))
        counts[n] = {k: next(s for lo, hi, s in plan[a] if lo <= r < hi) for k, (a, r) in home.items()}
        load = collections.Counter(counts[n].values())
        assert max(load.values()) <= 1.25 * 20_000 / n + 2
    moved = sum(counts[20][k] != counts[21][k] for k in counts[20])
    assert moved < 0.25 * 20_000          # 1/21 would be the least, a fresh deal moves 95 %


def brute_stats(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    ls = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    c = collections.Counter(tri)
    cov = {j for i, x in enumerate(tri) if c[x] > 1 for j in range(i, i + 3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(ls) - len(set(ls)), len(cov))


def test_quality_stats():
    for t in ("", " ", "a b c a b c", "a\na\n\n b\n b", prose(1) + prose(1), "x" * 50, "# * | a%b", "a b a b a b a", lined(3) + "\n" + lined(3),
              "ä ö b c"):
        assert quality.text_stats(t)[:5] == brute_stats(t), t


def test_quality_thresholds(spark, edge, empty):
    assert quality.certify(10_000, [0, 0, 60, 400], [5, 9, 9, 50], 0.01, 0.001) == 1    # the most lenient with as many
    assert quality.certify(100, [0], [50], 0.01, 0.001) == -1                           # too few to be sure
    p = sum(__import__("math").comb(50, i) * 0.1 ** i * 0.9 ** (50 - i) for i in range(3))
    assert abs(quality.binomial_below(2, 50, 0.1) - p) < 1e-12
    good = [(i, prose(i, 80), "en", "s", 0, 0, 0, "") for i in range(3000)]
    bad = [(10_000 + i, " ".join(w + "%%%" for w in prose(i, 80).split()), "en", "s", 0, 0, 0, "") for i in range(60)]
    docs = spark.createDataFrame(good + bad, SCHEMA)
    labels = docs.select("doc_id", (F.col("doc_id") < 10_000).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert set(ids(kept)) == set(range(3000))
    no = labels.limit(0)
    want = sorted((r.doc_id for r in edge.collect() if brute_stats(r.text)[0] >= 50 and 2 * brute_stats(r.text)[4] <= brute_stats(r.text)[0]),
                  key=lambda x: (x is None, x))
    assert ids(quality.keep_good(edge, no)) == want
    assert quality.keep_good(empty, no).count() == 0


def brute_lines(docs, run=50):
    words = lambda x: len(re.findall(r"[^\x20\x09-\x0D]+", x))
    first, gone = {}, collections.defaultdict(set)
    for d, text in sorted(docs.items()):
        ls = [(p, x) for p, x in enumerate(text.split("\n")) if words(x)]
        for i, (p, _) in enumerate(ls):
            n, j = 0, i
            while j < len(ls) and n < run:
                n += words(ls[j][1])
                j += 1
            if n < run:
                continue
            key, last = tuple(x for _, x in ls[i:j]), ls[j - 1][0]
            if key not in first:
                first[key] = (d, p, last)
            else:
                o = first[key]
                gone[d].update(range(max(p, o[2] + 1) if o[0] == d else p, last + 1))
    return {d: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone[d]) for d, t in docs.items()}


def test_line_dedup(spark, edge, empty):
    r = random.Random(5)
    pool = [prose(f"l{i}", r.choice([1, 3, 9, 14, 60])) for i in range(40)]
    starts = {d: [r.randrange(40) for _ in range(r.randint(1, 6))] for d in range(60)}
    docs = {d: "\n".join(x for k in ks for x in (pool[k:k + 6] if k else [""])) for d, ks in starts.items()}
    got = lines.dedup_lines(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"))
    assert {x.doc_id: x.text for x in got.collect()} == brute_lines(docs)
    out = lines.dedup_lines(edge)
    assert out.columns == edge.columns and out.count() == edge.count()
    by = {x.doc_id: x.text for x in out.collect() if x.doc_id is not None}
    assert by[10] == "start\nend" and by[0] is None and by[1] == "" and by[9] == lined("a")
    assert lines.dedup_lines(empty).count() == 0


def test_packing(edge, empty):
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encode = packing.encoder(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    odd = ["", " a", "a  b", "a \nb", "a\n b ", "<|endoftext|>", "it's we'll 12 3", "é　ü x", prose(4), "\x1c a\x1db"]
    for x in odd:
        assert np.frombuffer(encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids
    pieces = packing.pack(edge).collect()
    seq, doc = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        seq[p.sequence_id].append((p.offset, p.length))
        doc[p.doc_id].append(p)
    padding = 0
    for s in seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 3 * 2048
    text = {r.doc_id: r.text for r in edge.collect()}
    for d, got in doc.items():
        if d in (None, 6):
            continue
        want = np.array(t.encode(text[d] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(got, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(want[at:at + p.length].tobytes())
            at += p.length
        assert at == len(want)
    assert sum(p.length for p in doc[6]) == 2 * doc[6][0].doc_tokens      # the repeated row is packed twice
    assert packing.pack(empty).count() == 0


def test_packing_added_tokens(spark):
    """Ids, lengths and offsets are those of the JSON tokenizer with its default flags, added tokens included."""
    import numpy as np
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "a  <|endoftext|>\n b", " <|endoftext|> ", "<|endoftext|",
             "it's  <|ENDOFTEXT|> é", "a <|endoftext|>b c " * 300, prose(4)]
    want = [np.array(t.encode(x, add_special_tokens=False).ids + [1], "<u4") for x in texts]
    assert want[0].tolist() == [64, 220, 50256, 275, 1]
    seen = [0] * len(texts)
    for p in packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect():
        assert p.doc_tokens == len(want[p.doc_id])
        assert p.ids_crc32 == zlib.crc32(want[p.doc_id][p.start:p.start + p.length].tobytes())
        seen[p.doc_id] += p.length
    assert seen == [len(w) for w in want]


def test_pack_block_carries():
    r = random.Random(1)
    items = [(i, r.randint(1, 5000)) for i in range(300)]
    windows, left = packing.pack_block(items, last=False)
    assert all(sum(n for _, _, n in w) == size for size, w in windows)
    assert sum(n for _, n in items) == sum(n for _, w in windows for _, _, n in w) + sum(n for _, _, n in left)
    sizes = [s for s, _ in windows]
    load = collections.Counter()
    for s, g in zip(sizes, packing.step_groups(sizes)):
        load[g] += s
    assert max(load.values()) - min(load.values()) <= 2048


def test_spotsigs(spark, edge, empty):
    one = edge.dropDuplicates().filter("doc_id is not null")
    texts = {r.doc_id: r.text or "" for r in one.collect()}
    order = sorted(texts, reverse=True)
    after = dict(zip(order, order[1:] + order[:1]))
    rows, w = spotsigs.with_next(one, "doc_id", "text")
    got = {r.doc_id: r._next for r in rows.filter("_own").collect()}
    assert got == {d: texts[n] for d, n in after.items()}
    sigs = one.select("doc_id", spotsigs.signatures(F.col("text")).alias("s")).collect()
    by = {r.doc_id: r.s for r in sigs}
    assert by[6] == by[7] and by[0] == by[1] and by[3] != by[4]
    words = [x for x in re.split(r"[^\w]+|_", texts[11].lower()) if x]
    stop = [i for i, x in enumerate(words) if x in spotsigs.ANCHORS]
    chains = {(words[i], *[x for x in words[i + 1:] if x not in spotsigs.ANCHORS][:3]) for i in stop}
    assert len(by[11]) == len([c for c in chains if len(c) == 4])
    assert spotsigs.with_next(empty, "doc_id", "text")[0].count() == 0


def test_spotsigs_similar(spark):
    r = random.Random(2)
    base = {i: [r.randrange(10**6) for _ in range(r.randint(3, 40))] for i in range(20)}
    sets = {}
    for i in range(120):
        s = set(base[r.randrange(20)])
        for _ in range(r.randint(0, 4)):
            s.add(r.randrange(10**6))
        sets[i] = sorted(s)
    df = spark.createDataFrame(list(sets.items()), "doc_id bigint, sigs array<bigint>")
    smallest = {}
    for i in sorted(sets):
        smallest.setdefault(tuple(sets[i]), i)
    reps = sorted(smallest.values())
    want = {(a, b) for a in reps for b in reps if a < b
            and len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b])) - 1e-9}
    assert {(x.a, x.b) for x in spotsigs.similar(df, "doc_id", "sigs", 0.8).collect()} == want


def test_toxicity(spark, edge, empty):
    r = random.Random(3)
    insults = ["idiot", "zorgle", "scum"]
    rows, labels = [], []
    for i in range(1500):
        bad = i % 4 == 0
        words = prose(i, 60).split()
        for _ in range(3 * bad):
            words.insert(r.randrange(60), r.choice(insults))
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.score(docs, lab).collect()
    held = [x for x in got if x.held_out]
    assert len(got) == 1500 and 200 < len(held) < 400
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 0) for x in got)
    assert sum(x.predicted == (x.doc_id % 4 == 0) for x in held) >= 0.97 * len(held)
    assert toxicity.score(edge, lab.limit(0)).filter("score = 0 and predicted = 0").count() == edge.count()
    assert toxicity.score(empty.select("doc_id", "text"), lab).count() == 0


def test_toxicity_features_without_gates():
    """Substitutions at the edge of a word are undone, and shouted words count in a long text of small letters."""
    def of(text):
        got = dict(zip(toxicity.FEATURES, toxicity.features(text, frozenset([b"idiot", b"stupid"]), {b"asshole": 2.0, b"ass": 2.0})))
        n = len(text.replace("!", " ").split())
        return round(got["undone"] * n), round(got["obfuscated"] * n), round(got["shouted"] * n)

    for word in ("1diot", "$tupid", "@sshole", "a$$", "a$$!", "1D10T", "!diot"):
        assert of(f"you are {word} here")[:2] == (1, 1) if word != "!diot" else of(f"you are {word} here")[0] == 1, word
    assert of("you idiot! an idiot, stupid!! and asshole") == (0, 0, 0)
    assert of("GO AWAY NOW " + "quiet " * 500) == (0, 0, 2)


def test_toxicity_small_language(spark):
    """Insults on under 2% of the toxic rows each, all in a small language, enter the lexicon."""
    rows, labels = [], []
    for i in range(3000):
        bad, small = i % 5 == 0, i % 100 < 5
        words = [f"v{w}" if small else w for w in prose(i, 30).split()]
        if bad:
            words[i % 30] = f"blarg{i // 100 % 3}" if small else "idiot"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = [x for x in toxicity.score(docs, lab).collect() if x.held_out and x.doc_id % 100 < 5]
    assert sum(x.doc_id % 5 == 0 for x in got) >= 3
    assert all(x.predicted == (x.doc_id % 5 == 0) for x in got)


def brute_components(docs, width, percent):
    sets = {}
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[d] = {tuple(w[i:i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()
    root = {d: d for d in docs}
    for a in sorted(docs):
        for b in sorted(docs):
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root[a], root[b]
                for d in docs:
                    if root[d] == max(x, y):
                        root[d] = min(x, y)
    return {d: (len(sets[d]), root[d]) for d in docs}


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 50)])
def test_jaccard(spark, edge, empty, width, percent, monkeypatch):
    monkeypatch.setattr(jaccard, "TILE_SETS", 8)           # several chunks
    monkeypatch.setattr(jaccard, "TILE_TOKENS", 2000)
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", 3)      # some shingles are frequent
    monkeypatch.setattr(jaccard, "BROADCAST_REPS", 10 if width == 5 else 1000)
    r = random.Random(width)
    docs = {}
    for i in range(150):
        w = prose(f"b{r.randrange(6)}", r.choice([20, 120, 125])).split()
        for _ in range(r.randrange(8)):
            w[r.randrange(len(w))] = f"x{r.randrange(3)}"
        docs[i] = " ".join(w).upper() if i % 7 == 0 else " ".join(w)
    docs |= {1000 + x.doc_id: x.text for x in edge.collect() if x.doc_id is not None and x.doc_id != 5}
    got = jaccard.similar_components(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), width=width, percent=percent)
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got.collect()} == brute_components(docs, width, percent)


def test_jaccard_edges(edge, empty):
    got = jaccard.similar_components(edge).collect()
    assert len(got) == edge.count()
    assert {x.component_id for x in got if x.doc_id in (6, 7)} == {6} and {x.component_id for x in got if x.doc_id in (3, 13)} == {3}
    assert all(x.component_id is None for x in got if x.doc_id is None)
    kept = jaccard.keep_one_each(edge)
    assert kept.columns == edge.columns
    assert ids(kept) == [0, 1, 2, 3, 4, 5, 6, 9, 11, 12, None, None]       # 7, 8, 10, 13 are copies
    assert jaccard.similar_components(empty).count() == 0 and jaccard.keep_one_each(empty).count() == 0


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(200, 260)] + [(r.randrange(300, 340), r.randrange(300, 340)) for _ in range(30)]
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: v for k, v in root.items() if k != v}


def test_mixing(spark, edge, empty):
    sizes = {"a": 100_000, "b": 10_000, "c": 5_000, None: 1}
    alpha = mixing.find_alpha(sizes, 0.6, 3.0)
    total = sum(sizes.values())
    w = mixing.weights({s: n / total for s, n in sizes.items()}, alpha)
    repeats = [w[s] * max(sizes[x] / w[x] for x in sizes) / sizes[s] for s in sizes]
    assert max(repeats) <= 3 + 1e-6 and min(repeats) >= 1 - 1e-9 and mixing.entropy(w) <= 0.6 + 1e-9
    assert abs(max(repeats) - 3) < 1e-6 or abs(mixing.entropy(w) - 0.6) < 1e-6       # a limit is met exactly
    r = random.Random(4)
    rows = [(i, prose(i, r.randint(1, 40)), "en", "hot" if i % 3 else f"s{i % 5}", 0, 0, 0, "") for i in range(3000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(docs).select("_row.doc_id", "_source", "_tokens", "_epoch", "_block", "_key.b", "_key.r").collect()
    n = {i: len(t.split()) + 1 for i, t, *_ in rows}
    have = collections.Counter()
    for i, t, _, s, *_ in rows:
        have[s] += n[i]
    plan = mixing.plan_mix(dict(have))
    by = collections.defaultdict(list)
    for x in got:
        by[x._source, x._epoch].append(x)
    for s, (_, whole, part) in plan.items():
        for e in range(whole):
            assert sorted(x.doc_id for x in by[s, e]) == sorted(i for i, _, _, z, *_ in rows if z == s)
        drawn = sum(x._tokens for x in by[s, whole])
        assert part <= drawn < part + max(n.values()) if part else not by[s, whole]
    out = mixing.mixed_rows(edge)
    assert out.columns == edge.columns and set(ids(edge)) == set(ids(out))
    assert mixing.mixed_rows(empty).count() == 0


def test_mixing_exponents():
    """The entropy equals the target, on either side of the natural one, or the repetition limit binds."""
    r = random.Random(8)
    for trial in range(200):
        sizes = {i: r.randint(1, r.choice([3, 100, 10 ** 6])) for i in range(r.randint(1, 30))}
        target, most = r.choice([0.3, 0.6, 0.9, 0.97, 1.0]), r.choice([1.0, 1.5, 2.0, 50.0, 1e9])
        alpha = mixing.find_alpha(sizes, target, most)
        m = mixing.mixture(sizes, target, most)
        assert m.repeats <= most * (1 + 1e-6) and m.alpha == alpha
        total = sum(sizes.values())
        w = mixing.weights({s: n / total for s, n in sizes.items()}, alpha)
        assert all(abs(m.plan[n][0] - w[s]) < 1e-12 for s, n in sizes.items())
        if len(sizes) > 1 and len(set(sizes.values())) > 1:
            assert abs(m.entropy - mixing.entropy(w)) < 1e-9
            binds = abs(m.repeats - most) < 1e-6 * most
            assert abs(m.entropy - target) < 1e-6 or binds or (alpha == 0 and m.entropy <= target)
    near = {f"s{i}": 1000 + i for i in range(8)}                 # natural entropy above the target
    m = mixing.mixture(near, 0.97, 1e9)
    assert m.alpha > 1 and abs(m.entropy - 0.97) < 1e-6
    assert abs(mixing.mixture(near, 0.97, 2.0).repeats - 2.0) < 1e-6 or abs(mixing.mixture(near, 0.97, 2.0).entropy - 0.97) < 1e-6


def test_op8_row_by_row(spark, tmp_path):
    r = random.Random(9)
    rows = [(i, None if i % 50 == 0 else prose(i, r.randint(1, 30)), None if i % 9 == 0 else "hot" if i % 3 else f"s{i % 4}", i, "x") for i in range(2500)]
    rows += [rows[10]] * 3
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, `_key` bigint, epoch string").write.parquet(f"{tmp_path}/documents.parquet")
    from popsight import llm
    df = llm.queries()["op8_temperature_mix"](spark, str(tmp_path))
    assert dict(df.dtypes)["doc_id"] == "bigint" and dict(df.dtypes)["epoch"] == "bigint"
    got = df.collect()
    tokens = {d: len((t or "").split()) + 1 for d, t, *_ in rows}
    sizes = collections.Counter()
    for d, _, s, *_ in rows:
        sizes[s] += tokens[d]
    m = mixing.mixture(dict(sizes))
    assert abs(m.entropy - 0.97) < 1e-6 or abs(m.repeats - 2) < 1e-6
    by = collections.defaultdict(list)
    for x in got:
        by[x.source, x.epoch].append(x)
        assert x.weight == round(m.plan[sizes[x.source]][0], 12)
    for s, n in sizes.items():
        _, whole, part = m.plan[n]
        mine = [(d, tokens[d]) for d, _, z, *_ in rows if z == s]
        for e in range(whole):
            assert sorted(x.doc_id for x in by[s, e]) == sorted(d for d, _ in mine)
        # the cut epoch is the beginning of its permutation, up to the row that reaches the part
        cut = sorted(by[s, whole], key=lambda x: (x.block_key, x.block, x.row_key))
        if not part:
            assert not cut
            continue
        total = sum(x.n_tokens for x in cut)
        assert total >= part
        lastkey = (cut[-1].block_key, cut[-1].block, cut[-1].row_key)
        assert sum(x.n_tokens for x in cut if (x.block_key, x.block, x.row_key) != lastkey) < part
    assert {x.epoch for x in got} <= {0, 1, 2} and {d for d, *_ in rows} == {x.doc_id for x in got}


def test_chat(spark):
    for x in ("", "\\", "\\.", "\\\\.<|end|>", "<|turn|>x", "</s>[INST] ok [/INST]", "<|<|end|>end|>", "a\\n\n"):
        assert chat.unescape(chat.escape(x)) == x and not chat._CONTROL.search(chat.escape(x))
        assert chat.parse(chat.render("a\nb" + x, x)[0]) == ("a\nb" + x, x)
    log = [(1, 0, 0, "message", "user", "hi"), (1, 0, 1, "edit", None, "hello"), (1, 1, 0, "message", "assistant", ""),
           (1, 1, 1, "delta", "assistant", "a"), (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "b"),
           (1, 1, 4, "delta", None, "c"), (1, 2, 0, "message", "user", "gone"), (1, 2, 1, "delete", None, None),
           (None, 0, 0, "message", None, None)]
    df = spark.createDataFrame(log, "conv bigint, message bigint, seq int, kind string, role string, text string")
    got = [(r.conv_id, *chat.parse(r.chunk), r.loss_start is not None) for r in chat.reconstruct(df).collect()]
    assert sorted(got, key=str) == sorted([(1, "user", "hello", False), (1, "assistant", "bc", True), (None, "", "", False)], key=str)
    import hashlib
    long = "x</s>" * 2000
    rows = [(5, 0, "user", None), (5, 1, "assistant", long), (5, 1, "assistant", long), (5, 2, "assistant", "<|end|>"), (7, 0, "system", "s")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {r.conv_id: r for r in chat.read_back(chat.reconstruct(chat.events_of(conv))).collect()}
    want = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in rows if c == 5)
    assert out[5].n_turns == 4 and out[5].turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert out[5].loss_chars == 2 * len(long) + 7
    assert out[5].loss_sha256 == hashlib.sha256((long * 2 + "<|end|>").encode()).hexdigest()
    assert chat.read_back(chat.reconstruct(df.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p>";</script></head><body><nav><ul><li><a>m</a></ul></nav>
<div class="ad">buy</div><div class="cookie-notice">c</div><article><header><h1>Head &amp; {i}</h1></header><p><b>First {i}<br>x
<p>Second&nbsp; &lt;{i}&gt;<div>Read our guide</div><p>shared line</p><form><input>q</form><section id="comments"><p>nice</p></section>
</article><aside>s</aside><div>Site strap line</div><footer>&copy;</footer>"""


def test_html(spark):
    rows = [(i, f"https://u@Host.example:80/{i}", PAGE.replace("{i}", str(i))) for i in range(8)]
    rows += [(20, None, None), (21, "https://other.example/", ""), (22, "https://other.example/", "plain < text &am"),
             (23, "https://other.example/", "<body><p>a<p>b</p><div hidden>h</div><!-- x"), rows[0]]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("clash"))
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for i in range(8):
        assert got[i] == f"Head & {i}\nFirst {i} x\nSecond <{i}>\nshared line"       # the strap in a div recurs: template
    assert got[20] == "" and got[21] == "" and got[22] == "plain < text &am" and got[23] == "a\nb"
    assert html.extract(pages).count() == 13 and html.extract(pages.limit(0)).count() == 0
    import popsight.llm.html as h
    salted, h.BROADCAST_SUBTREES = h.BROADCAST_SUBTREES, -1
    try:
        assert {r.page_id: r.text for r in html.extract(pages).collect()} == got
    finally:
        h.BROADCAST_SUBTREES = salted


def test_html_copies_and_large_hosts(spark):
    """Copies keep their text (with and without <article>); a side bar on 150 of 2,000 pages goes, and what three pages share."""
    page = "<body><div>Frame</div>{0}<div class=x>{1}</div></body>".format
    body = "<div class=body>" + "".join(f"<p>{prose(f'copy{i}', 30)}</p>" for i in range(3)) + "</div>"
    rows = [("copies", page("", body))] * 40 + [("marked", f"<article>{body}<p>end</p></article>")] * 40
    rows += [("ads", page(f"<div>ad {i}</div>", body)) for i in range(40)]
    rows += [("large", page("<div>Side bar</div>" if i < 150 else "", f"<p>text of {prose(i, 9)}</p>")) for i in range(2000)]
    rows += [("small", page("", f"<p>text of {prose(i, 9)}</p>")) for i in range(3)]
    pages = spark.createDataFrame([(i, f"http://{h}/{i}", x) for i, (h, x) in enumerate(rows)], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract(pages).collect()}
    for i, (host, _) in enumerate(rows):
        if host in ("copies", "marked", "ads"):
            assert all(prose(f"copy{k}", 30) in got[i] for k in range(3)), host
        else:
            assert got[i].startswith("text of") and "\n" not in got[i], (host, got[i])


def test_html_names_keep_the_article():
    body = "<p>" + "main text of the page " * 20 + "</p>"
    words = " ".join(("main text of the page " * 20).split())
    for page in (f'<article class="post no-comments">{body}</article>', f'<div class="site no-sidebar"><article>{body}</article></div>',
                 f'<div id="page" class="hfeed has-footer-widget">{body}</div>', f'<div class="sidebar-layout"><article>{body}</article></div>',
                 f'<div class="widget"><article>{body}</article></div>', f'<div class="widget">{body}<div class="ad">x y</div></div><div class="footer">f</div>',
                 f'<div class="related-work">{body}</div>', f'{body}<div class="comment-list"><article class="comment"><p>{"c " * 900}</p></article></div>'):
        assert html.main_text(page, set()) == words, page
    kept = html.main_text(f'<article><p class="share-price">Price words</p>{body}<div class="share-buttons">s</div></article>', set())
    assert kept == "Price words\n" + words
    for name in ("ad", "ads", "site-footer", "cookie-notice", "sidebar", "comments-area", "social-share", "menu-item", "newsletter-box", "page-header"):
        assert html.main_text(f'<div class="x {name}">gone</div><p>stays here</p>', set()) == "stays here", name
    assert html.main_text(f'<div class="cookie-notice"><p>{"we use cookies " * 50}</p></div><p>stays</p>', set()) == "stays"


def test_html_long_shared_block_and_nesting(spark):
    """A long text that all pages share is template, whatever its length; 100,000 nested tags take linear time."""
    legal = "<div>" + "terms and conditions apply to all use of this site " * 40 + "</div>"
    page = "<body><div>Site strap line</div><div class=x><p>{0}</p></div><ul><li>Top stories today</li></ul>{1}</body>".format
    rows = [(i, f"http://legal.example/{i}", page(f"Own words number {i} of this page", legal)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    assert got == {i: f"Own words number {i} of this page" for i in range(40)}
    import time
    took = []
    for n in (20_000, 100_000):
        began = time.process_time()
        assert html.main_text("<x>" * n + "deep" + "</y>" * n, set()) == "deep"
        took.append(time.process_time() - began)
    assert took[1] < 15 * took[0] + 0.5


def test_op9_as_registered(spark, tmp_path):
    """Its log holds edits, regenerations and deletions; what is read back are the table's rows. Cutting is linear."""
    import hashlib
    from popsight import llm
    r = random.Random(12)
    rows = [(c, t, ["user", "assistant", "system", None][r.randint(0, 3)], None if r.random() < 0.1 else r.choice(["<|end|>", "é\n😀", "</s>\\ "]) * r.randint(0, 700))
            for c in range(40) for t in range(5)]
    rows += [rows[3]] * 2 + [(None, 0, "user", "x")]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    given = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    log = chat.events_of(given)
    kinds = {x.kind: x["count"] for x in log.groupBy("kind").count().collect()}
    assert set(kinds) == set(chat.KINDS) and log.agg(F.max(F.length("text"))).first()[0] <= 128 + 700 * 7
    got = {x.conv_id: x for x in llm.queries()["op9_event_sourced_chat"](spark, str(tmp_path)).collect()}
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t, role or "", text or ""))
    assert set(got) == set(by) | {-1}
    for c, own in by.items():
        assert got[c].n_turns == len(own)
        if len({(t, role) for t, role, _ in own}) == len(own):
            own.sort()
            assert got[c].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in own).encode()).hexdigest()
            said = "".join(b for _, a, b in own if a == "assistant")
            assert (got[c].loss_chars, got[c].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    import time
    took = []
    for n in (500_000, 4_000_000):
        one = spark.createDataFrame([(1, 0, "assistant", "x")], "conv_id bigint, turn bigint, role string, text string").withColumn("text", F.repeat("text", F.lit(n)))
        began = time.time()
        assert chat.events_of(one).where("kind = 'delta'").agg(F.sum(F.length("text"))).first()[0] >= n
        took.append(time.time() - began)
    assert took[1] < 8 * took[0] + 5


def test_toxic_words_are_learned_as_they_are_looked_up(spark):
    """One tokeniser: substituted letters and capitals beyond A-Z hit; edge rows go through the features and trees."""
    r = random.Random(3)
    bad = ["b$dling", "@zzoff", "ärgling"]
    rows = [(i, prose(f"t{i}", 20) + (f" {bad[i % 3].upper() if i % 6 == 0 else bad[i % 3]}!" if i % 4 == 0 else ""), "en", "s", 0, 0, 0, "") for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)], "doc_id bigint, quality int, toxic int")
    fixed = frozenset()
    docs = spark.createDataFrame(rows, SCHEMA)
    fit = docs.join(labels.select("doc_id", F.col("toxic").alias("label")), "doc_id").withColumn("part", (F.col("doc_id") % toxicity.FOLDS).cast("int"))
    learned = toxicity.learn_lexicons(fit)[0]
    assert {w.encode() for w in bad} <= set(learned)
    for text in ("b$dling", "B$DLING!", "@zzoff,", "Ärgling", "ÄRGLING."):
        assert toxicity.features(text, fixed, learned)[toxicity.FEATURES.index("n_learned")] == 1.0, text
    edges = spark.createDataFrame([(1000, None), (1001, ""), (1002, " \n"), (None, "b$dling"), (1003, "b$dling " * 20000), (1003, "x"), (1003, "x")],
                                  "doc_id bigint, text string").select("doc_id", "text", F.lit(1).alias("label"), F.lit("x").alias("features"))
    got = toxicity.score(docs.select("doc_id", "text", F.lit(1).alias("label"), F.lit("x").alias("features")).unionByName(edges), labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"] and got.count() == 407
    found = {x.doc_id: x.predicted for x in got.where("doc_id < 400").collect()}
    assert sum(found[i] == int(i % 4 == 0) for i in range(400)) > 380
    assert toxicity.score(docs.limit(0), labels).count() == 0


def test_pipeline(spark, edge, empty, tmp_path):
    import corpus_pipeline as cp
    edge.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1, 0)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == edge.columns, name
        assert stage(spark, empty, str(tmp_path)).count() == 0
    assert cp.run(spark, str(tmp_path)).count() > 0
