import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import backoff_lm, exact_dedup, language_id, licences, line_templates, mixing, near_dedup, piece_transducer, rp_forest, textblocks, url_filter

SPACES = re.compile("[\x20\x09-\x0d]+")
LONG = " ".join(f"w{i}" for i in range(60_000))
TEXTS = ["a  b\tc", "a b c", "", None, " ", "\n", "a b c", LONG, LONG + " ", "ä  ö", "one two three four five six seven"]


def docs(spark, texts, **more):
    rows = [(i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'src' || doc_id % 3 AS source", "1 AS keep_id", "2 AS `text_sha256`", "'en' AS lang")


def nothing(spark):
    return docs(spark, ["x"]).limit(0)


# textblocks


def test_blocks_hold_whole_texts_and_words_agree():
    import pyarrow as pa

    data, offsets = textblocks.column(pa.array(TEXTS))
    seen = 0
    for lo, hi, block, at in textblocks.blocks(data, offsets, 64):
        starts, ends, first = textblocks.words(block, at)
        for k in range(hi - lo):
            got = [block[a:b].tobytes().decode() for a, b in zip(starts[first[k] : first[k + 1]], ends[first[k] : first[k + 1]])]
            assert got == [w for w in SPACES.split(TEXTS[lo + k] or "") if w]
        seen += hi - lo
    assert seen == len(TEXTS)


def test_hashes_do_not_depend_on_place():
    block = np.frombuffer(b"abc xyz abc", dtype=np.uint8)
    h = textblocks.hashes(block, np.array([0, 4, 8]), np.array([3, 7, 11]))
    assert h[0] == h[2] != h[1]


# exact dedup


def plain_groups(texts):
    keep = {}
    for i, t in enumerate(texts):
        keep.setdefault(SPACES.sub(" ", t or ""), []).append(i)
    return {i: (g[0], len(g), i == g[0], hashlib.sha256(t.encode()).hexdigest()) for t, g in keep.items() for i in g}


def test_exact_dedup(spark):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.decisions(docs(spark, TEXTS), memory=1000).collect()}
    assert got == plain_groups(TEXTS)
    kept = exact_dedup.keep_first(docs(spark, TEXTS), memory=1000)
    assert kept.columns == docs(spark, TEXTS).columns
    assert {r.doc_id: r.text for r in kept.collect()} == {i: TEXTS[i] for i, v in plain_groups(TEXTS).items() if v[2]}


def test_exact_dedup_nulls_repeats_empty(spark):
    rows = spark.createDataFrame([(None, "x"), (3, "x"), (3, "x"), (None, "y"), (None, "y")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup.decisions(rows).collect())
    assert got == [("3", "3", 3, False), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 2, False), ("None", "None", 2, True)]
    assert exact_dedup.decisions(nothing(spark)).count() == 0 and exact_dedup.keep_first(nothing(spark)).count() == 0


def test_grace_spills_and_compares_content():
    random.seed(3)
    texts = [bytes([random.randrange(3)]) * random.randrange(1, 400) for _ in range(3000)]
    for hasher in (exact_dedup.content_hash, lambda c: 7):  # all hashes equal: content alone decides
        got = {c: (key, n) for _, c, key, n, _ in exact_dedup.grace(((t, (0, i), 1, None) for i, t in enumerate(texts)), 4000, hasher)}
        want = {t: ((0, texts.index(t)), n) for t, n in Counter(texts).items()}
        assert got == want


# near dedup


def plain_classes(texts):
    sets = []
    for t in texts:
        w = [x for x in SPACES.split((t or "").translate({c: c + 32 for c in range(65, 91)})) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in enumerate(sets)}


def near_texts():
    random.seed(5)
    base = [f"b{random.randrange(10**6)}" for _ in range(80)]
    out = ["a b", "A  B", "a b c", "", None, " ", LONG, LONG + " end"]
    for _ in range(60):  # copies with edits from a small stock, so that many are just below the threshold of each other
        w = list(base)
        for _ in range(random.randrange(0, 6)):
            w[random.randrange(80)] = random.choice(["x", "y", "z"])
        out.append(" ".join(w))
    return out + [" ".join(f"u{random.randrange(10**6)}" for _ in range(30)) for _ in range(20)]


def test_near_dedup(spark):
    texts = near_texts()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.classify(docs(spark, texts)).collect()}
    assert got == plain_classes(texts)


def test_near_dedup_edges(spark):
    rows = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, "q")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dedup.classify(rows).collect())
    assert got == [("4", "4", True), ("4", "4", True), ("9", "9", True), ("None", "None", False)]
    assert near_dedup.classify(nothing(spark)).count() == 0
    assert near_dedup.keep_one(rows).count() == 4


# language identification


def test_language_id(spark):
    words = {"en": "the of and that this with", "de": "der und nicht auch eine für", "fr": "les des pour dans être où"}
    random.seed(2)
    rows = [(i, " ".join(random.choices(words[l].split(), k=40)), l) for i, l in enumerate(random.choices(list(words), k=400))]
    extra = [(900, None, "en"), (901, "123 456!", "en"), (902, "", "de"), (903, "日本", None), (None, "the of and that", "en")]
    d = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in language_id.split_predict(d).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3 and got[903].lang_pred in words and got[None].lang_pred == "en"
    assert {r.doc_id for r in language_id.keep_known(d).collect()} == set(got) - {900, 901, 902}
    assert language_id.split_predict(d.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.split_predict(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_pipeline_rejects_what_no_language_supports(spark):
    import corpus_pipeline

    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    random.seed(4)
    noise = " ".join("".join(random.choices("bcdfghjklmnpqrstvwxz", k=7)) for _ in range(60))
    texts = {-1: "日本語の文章はここにあります", -2: noise, -3: "Это предложение написано на русском языке", -4: "A.", -5: None, -6: "123"}
    row = given.where("lang is not null").limit(1).collect()[0].asDict()
    more = spark.createDataFrame([tuple((row | {"doc_id": i, "text": t}).values()) for i, t in texts.items()], given.schema)
    kept = {r.doc_id for r in corpus_pipeline.languages(spark, given.unionByName(more), "").collect()}
    assert kept == {r.doc_id for r in given.collect() if any(c.isalpha() for c in r.text or "")} | {-4}


# SentencePiece


def test_transducer_equals_library():
    import sentencepiece

    raw = piece_transducer.read_model()
    ours, theirs = piece_transducer.Transducer(raw), sentencepiece.SentencePieceProcessor(model_proto=raw)
    random.seed(1)
    stock = [" ", "  ", "   "] + list("abcdefgththeANDéèüñ.,\n\t0123<>▁日本語\x00😀ﬁ　'-")
    for _ in range(3000):
        t = "".join(random.choices(stock, k=random.randrange(40)))
        ids = np.frombuffer(ours.encode(t), dtype=np.int32).tolist()
        assert ids == theirs.encode(t) and ours.decode(ids) == theirs.decode(ids)
    for n in range(40):
        assert np.frombuffer(ours.encode("x" + " " * n), dtype=np.int32).tolist() == theirs.encode("x" + " " * n)


def test_encode_decode(spark):
    raw = piece_transducer.read_model()
    d = docs(spark, TEXTS).withColumn("ids", F.lit("clash"))
    out = piece_transducer.encode(d, raw, keep=["doc_id", "ids"], out="tokens")
    back = {r.doc_id: (r.tokens, r.decoded) for r in piece_transducer.decode(out, raw, "tokens").collect()}
    assert all(back[i][1] == t for i, t in enumerate(TEXTS)) and back[3][0] is None and back[2][0] == []
    rep = {r.doc_id: r for r in piece_transducer.report(d, raw).collect()}
    assert all(rep[i].round_trip for i, t in enumerate(TEXTS) if t is not None) and rep[3].n_tokens is None
    assert piece_transducer.report(nothing(spark), raw).count() == 0


def test_unigram_shortest_path():
    class Model(piece_transducer.Transducer):
        def __init__(self):
            self.score = {"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -9.0, "c": -1.0}
            self.prefixes = {p[:k] for p in self.score for k in range(1, len(p) + 1)}
            self.penalty, self.bpe = 20.0, False

    assert Model().segment("abcab?") == ["ab", "c", "ab", "?"]


# language model


def test_backoff_scores(spark):
    texts = ["a b c a b", "a b c d", "", None, "a b", "z", "a b c a b"]
    got = {r.doc_id: (r.n_tokens, r.log_score) for r in backoff_lm.score(docs(spark, texts), chunk=8, bucket=3).collect()}
    words = [SPACES.split(t) if t else [] for t in texts]
    grams = lambda w, n: Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    total = sum(map(len, words))
    for k, w in enumerate(words):
        f = {n: sum((grams(x, n) for j, x in enumerate(words) if j != k), Counter()) for n in (1, 2, 3)}

        def s(i, n):
            g = tuple(w[i - n + 1 : i + 1])
            if n == 1:
                return max(f[1][g], 1) / max(total - len(w), 1)
            return f[n][g] / f[n - 1][g[:-1]] if f[n][g] else 0.4 * s(i, n - 1)

        assert got[k] == (len(w), pytest.approx(sum(np.log(s(i, min(i + 1, 3))) for i in range(len(w)))))
    assert backoff_lm.score(nothing(spark)).count() == 0


def test_backoff_messages_grow_with_the_chunks(spark):
    rng = random.Random(4)
    text = lambda: " ".join(f"w{rng.randrange(3000)}" for _ in range(200))
    sent = []
    for times in (1, 4, 16):
        rows = docs(spark, [text() for _ in range(40 * times)]).selectExpr("doc_id as id", "text")
        asked = backoff_lm._asked(backoff_lm._dealt(rows, 4 * times), min(16, 8 * times))
        by_chunk = [r["count"] for r in asked.groupBy("chunk").count().collect()]
        assert len(by_chunk) == 4 * times and max(by_chunk) <= 3 * 16
        sent.append(sum(by_chunk))
    assert sent[2] <= 4 * sent[1] and sent[2] <= 16 * 3 * 16 * 4


def test_backoff_scores_do_not_depend_on_the_cut(spark):
    rng = random.Random(5)
    df = docs(spark, [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 60))) for _ in range(40)])
    one = sorted(map(tuple, backoff_lm.score(df).collect()), key=lambda r: r[0])
    many = sorted(map(tuple, backoff_lm.score(df, chunk=100, bucket=7, ranges=3).collect()), key=lambda r: r[0])  # ranges hold many times `bucket` n-grams
    assert [r[:2] for r in one] == [r[:2] for r in many]
    assert [r[2] for r in one] == pytest.approx([r[2] for r in many])


def test_backoff_hashes_do_not_meet(spark):
    words = [f"w{i}" for i in range(200_000)]
    block, ends = np.frombuffer(" ".join(words).encode(), dtype=np.uint8), np.cumsum([len(w) + 1 for w in words]) - 1
    high = textblocks.hashes(block, np.concatenate(([0], ends[:-1] + 1)), ends) >> np.uint64(36)
    order = np.argsort(high, kind="stable")
    k = int(np.flatnonzero(high[order][1:] == high[order][:-1])[0])  # two words that agree in the 28 bits that such a corpus had
    a, b = words[order[k]], words[order[k + 1]]
    got = {r.doc_id: r.log_score for r in backoff_lm.score(docs(spark, [a, f"{b} {b} {b}"])).collect()}
    assert got[0] == pytest.approx(np.log(1 / 3))


def test_packing():
    x = np.sort(np.random.default_rng(0).integers(0, 2**63, 1000).astype(np.uint64))
    assert (backoff_lm.unpack_sorted(backoff_lm.pack_sorted(x)) == x).all() and len(backoff_lm.unpack(backoff_lm.pack(x[:0]))) == 0


# line templates


def test_line_templates(spark):
    page = [f"unique words {chr(97 + i)} only here\nPage {i} of 9\nCopyright by the {n} company all rights reserved\n\nsame line" for i, n in enumerate(["red", "blue", "green", "big", "new", "old"])]
    texts = page + [page[0]] * 9 + ["a clean text\nsame line", None, "", LONG, "twice said\ntwice said"]
    out = {r.doc_id: r for r in line_templates.clean(docs(spark, texts)).collect()}
    assert all(out[i].text == f"unique words {chr(97 + i)} only here\n" for i in range(6))
    assert out[15].text == "a clean text" and out[16].text is None and out[17].text == "" and out[18].text == LONG and out[19].n_dropped == 0
    assert line_templates.report(nothing(spark)).count() == 0


def plain_grow(lines):
    templates, out = [], []
    for line, _ in lines:
        row = line.split(b" ")
        same = [sum(a == b for a, b in zip(t, row)) for t in templates]
        at = max(range(len(same)), key=lambda k: (same[k], -k), default=-1)
        if at >= 0 and same[at] >= line_templates.ALIKE * len(row):
            templates[at] = [a if a == b else line_templates.ANY for a, b in zip(templates[at], row)]
        else:
            at = len(templates)
            templates.append(row)
        out.append(at)
    return out


def grow(lines):
    tree = line_templates.Leaf(lines[0][0])
    return [0, *(tree.add(line) for line, _ in lines[1:])]


def plain_clean(texts):
    """Each text without its dropped lines, by one dictionary of leaves."""
    seen, leaves = {}, {}
    for text in {t for t in texts if t}:
        for m in {line_templates.masked(x) for x in text.encode().split(b"\n")} - {b""}:
            seen.setdefault(m, set()).add(text)
    for m in seen:
        tokens = m.split(b" ")
        leaves.setdefault((len(tokens), *tokens[: line_templates.LEADING]), []).append(m)
    gone = set()
    for lines in leaves.values():
        lines = sorted(lines, key=lambda m: (-len(seen[m]), m))
        members = {}
        for m, at in zip(lines, plain_grow([(m, 0) for m in lines])):
            members.setdefault(at, []).append(m)
        for ms in members.values():
            if len(set().union(*(seen[m] for m in ms))) >= line_templates.DOCUMENTS:
                gone.update(ms)
    return [None if t is None else "\n".join(x for x in t.split("\n") if line_templates.masked(x.encode()) not in gone) for t in texts]


def test_lines_equal_plain(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = df.collect()
    want = sorted(zip((r.doc_id for r in rows), plain_clean([r.text for r in rows])), key=repr)
    assert sorted(((r.doc_id, r.text) for r in line_templates.clean(df).collect()), key=repr) == want


def test_indexed_leaf_equals_plain():
    random.seed(6)
    for width in (4, 5, 7, 10, 20):
        kinds = [[random.choice("pqrst") + random.choice("uvw") for _ in range(width - 3)] for _ in range(60)]
        rows = {" ".join(["a", "b", "c", *(random.choice(["x", "y", "<*>"]) if random.random() < 0.2 else t for t in random.choice(kinds))]).encode() for _ in range(900)}
        lines = [(r, 1) for r in sorted(rows, key=lambda r: hashlib.md5(r).digest())]
        assert grow(lines) == plain_grow(lines)


def test_large_leaf_is_parsed_like_a_small_one(spark):
    random.seed(7)
    one = [f"only {w} here\na b c {w} e f g h i j" for w in ("red", "blue", "green", "big", "new", "old")]
    many = "\n".join("a b c " + " ".join("".join(random.choices("klmnopq", k=5)) for _ in range(7)) for _ in range(21_000))
    for texts in (one, [*one, many]):
        out = {r.doc_id: r for r in line_templates.clean(docs(spark, texts)).collect()}
        assert [out[k].n_dropped for k in range(6)] == [1] * 6 and out.get(6, out[0]).n_dropped == (0 if 6 in out else 1)


# forest


def test_forest(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16))
    v = (centres[rng.integers(0, 20, 1000)] + 0.3 * rng.normal(size=(1000, 16))).astype(np.float32)
    v[1:300] = v[0]
    rows = [(i, [float(x) for x in r], 0) for i, r in enumerate(v)] + [(2000, None, 0), (2020, [0.0] * 16, 0), (2040, [float("nan")] * 16, 0), (2060, [None] * 16, 0), (2080, [1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got: dict = {}
    for r in rp_forest.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x, hits = v.astype(np.float64), 0
    assert set(got) == set(range(0, 1000, 20)) and all(len(g) == 20 for g in got.values())
    for q, g in got.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(1000), -s))[:20]) & {i for i, _ in g})
        assert g == sorted(g, key=lambda p: (-p[1], p[0]))
    assert hits / 1000 >= 0.9
    assert rp_forest.search(df.limit(0)).count() == 0


# URL filters


def test_url_filter(spark):
    h = [
        (1, "http://a.org/x", '<link rel="canonical" href="https://B.net/fr/1">'),
        (2, "http://c.org/", "<meta http-equiv='refresh' content='0; url=http://a.org/x#z'>"),
        (3, "http://d.org/", None),
        (4, None, "x"),
        (5, "nothing", '<link rel=canonical href="/q">'),
        (6, "http://e.org/a/b?utm_x=1", '<LINK href="c" rel="canonical">'),
        (7, "http://e.org/a/c", '<meta http-equiv=refresh content="5;URL=http://www.example.com/en/7"><link rel=canonical href=http://x.net/es/>'),
        (8, "ftp://M.Example.COM/en/q?x#y", ""),
        (9, "http://www.example.com/en/", ""),
        (10, "http://notexample.com/en/", ""),
        (11, "http://example.com", ""),
        (None, "http://net/es/", ""),
    ]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(h, "page_id long, url string, html string")).collect()}
    assert [got[i][3] for i in (1, 2, 3, 6, 7)] == ["block", "block", "allow", "allow", "allow"]
    assert got[4] == got[5] == ("", "", None, "allow") and got[8] == ("m.example.com", "/en/q", "example.com/en/", "block")
    assert got[9][2:] == ("www.example.com/en/", "allow") and got[10][2:] == ("com/", "allow") and got[11][2:] == (None, "allow") and got[None][3] == "block"


# mixing


def test_mixing(spark):
    rows = [(i, "big" if i % 3 else None if i % 2 else f"s{i % 7}") for i in range(1500)] + [(None, "big")] * 40 + [(7, "big")] * 300
    df = spark.createDataFrame([(i, s, 1) for i, s in rows], "doc_id long, source string, slot int")
    got = mixing.placements(df).collect()
    assert sorted((r.doc_id or -1, r.source or "") for r in got) == sorted((i or -1, s or "") for i, s in rows)
    by_source: dict = {}
    for i, s in rows:
        by_source.setdefault(s, []).append("" if i is None else i)
    assert sorted(r.position for r in got) == sorted(windows_positions(by_source))
    moved = mixing.interleave(df)
    assert moved.columns == df.columns and sorted(map(tuple, moved.collect()), key=repr) == sorted(((i, s, 1) for i, s in rows), key=repr)
    assert mixing.placements(df.limit(0)).count() == mixing.interleave(df.limit(0)).count() == 0
    alone = mixing.placements(df.where("source = 's0'")).collect()
    assert sorted(r.position for r in alone) == list(range(len(alone)))


def windows_positions(ids_by_source, block=16):
    """Positions that any order of a source's rows fills: those of as many ids as it has."""
    return plain_positions({s: [f"{s}{k}" for k in range(len(ids))] for s, ids in ids_by_source.items()}, block).values()


def test_mixing_deviates_by_less_than_a_block(spark):
    weights = {"a": "1/3", "b": "1/7", "c": 0.001, "d": "10979/21000", "none": 0}
    whole, total = mixing.exact_weights(weights)
    assert (whole, total) == ({"a": 7000, "b": 3000, "c": 21, "d": 10979, "none": 0}, 21000)
    rows = spark.range(200_000).selectExpr("id AS doc_id", "CASE WHEN id % 1000 = 0 THEN 'c' WHEN id < 66000 THEN 'a' WHEN id < 96000 THEN 'b' WHEN id < 199990 THEN 'd' WHEN id < 199995 THEN 'none' ELSE 'other' END AS source")
    got = mixing.placements(rows, weights=weights, block=2).collect()
    assert len(got) == 200_000 and {r.source for r in got if r.slot is None} == {"none", "other"}
    slots: dict = {}
    for r in got:
        if r.slot is not None:
            slots.setdefault(r.source, {})[r.block] = r.slot
            assert r.release == r.block * total // whole[r.source] <= r.slot < r.deadline == -(-(r.block + 1) * total // whole[r.source])
    end = min(max(x.values()) for x in slots.values())  # until then every source has rows
    assert end > 3 * total
    for s, at in slots.items():
        at, w = np.sort(np.fromiter(at.values(), dtype=np.int64)), whole[s]
        done = np.arange(1, len(at) + 1)  # blocks done after each of its slots, and one less just before
        assert (np.abs(done * total - (at + 1) * w)[at <= end] < total).all() and (np.abs((done - 1) * total - at * w)[at <= end] < total).all()
    with pytest.raises(ValueError, match="common denominator"):
        mixing.exact_weights({"a": "1/9999991", "b": 1})


def test_mixing_of_many_sources(spark):
    got = mixing.placements(spark.range(3000).selectExpr("id AS doc_id", "'s' || id % 1200 AS source"), block=1).collect()
    assert sorted({r.source for r in got}) == sorted(f"s{k}" for k in range(1200))
    assert all(r.release <= r.slot < r.deadline for r in got) and len({r.slot for r in got}) == 3000


def test_licences(spark):
    rows = [("a/LICENSE", "MIT License\nReleased under the MIT License."), ("a/b/x.py", "code\nmore"), ("a/b/y.py", "# Licensed under the Apache License, Version 2.0\n" + "w " * 50), ("c/z.py", None), (None, "All rights reserved."), ("c/d", "a license to thrill and nothing else that is known")]
    df = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.licence, r.origin, r.licensed_dir) for r in licences.scan(df, df["path"], df["text"], {"score_": df["path"]}).collect()}
    assert got["a/LICENSE"][:2] == ("MIT", "own") and got["a/b/x.py"] == ("MIT", "inherited", "a") and got["a/b/y.py"][:2] == ("Apache-2.0", "own")
    assert got[""][0] == "Proprietary" and got["c/z.py"] == ("Proprietary", "inherited", "") and got["c/d"][1] == "inherited"


def test_licence_blocks(spark):
    filler = "\n".join(f"word{k} other{k}" for k in range(400))
    rows = [
        ("g/COPYING", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n" + filler),
        ("g/src/a.c", "int main;"),
        ("m/a.js", "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this\n * file, You can obtain one at http://mozilla.org/MPL/2.0/. */\n\n" + filler),
        ("b/x.py", "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are\n# met:\n#\n" + filler),
        ("t/text.txt", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software, and to permit persons to whom the Software is\nfurnished to do so, subject to the following conditions:\n"),
        ("t/sub/y.py", "y"),
        ("c/z.py", "Copyright (c) 2020 Foo. All rights reserved.\n" + filler),
        ("c/z.py", "x"),
        ("c/z.py", "x"),
        ("l/long.txt", filler * 300 + "\n// Licensed under the Apache License, Version 2.0.\n"),
        ("p/prose.txt", " ".join(["they talked about a license for hours and"] * 40)),
    ]
    df = spark.createDataFrame([(p, t, 1, "x") for p, t in rows], "path string, text string, licence int, line string")
    out = licences.scan(df, df["path"], df["text"], {"id": df["path"]}).collect()
    got = {r.path: (r.licence, r.origin) for r in out}
    assert len(out) == len(rows) and got["g/COPYING"] == ("GPL-3.0", "own") and got["g/src/a.c"] == ("GPL-3.0", "inherited")
    assert got["m/a.js"] == ("MPL-2.0", "own") and got["b/x.py"] == ("BSD-3-Clause", "own") and got["t/text.txt"] == ("MIT", "own") and got["t/sub/y.py"] == ("MIT", "inherited")
    assert got["c/z.py"] == ("Proprietary", "own") and got["l/long.txt"] == ("Apache-2.0", "own") and got["p/prose.txt"] == (None, None)
    assert licences.scan(df.limit(0), df["path"], df["text"], {"id": df["path"]}).count() == 0


# pipeline


def test_pipeline(spark):
    import corpus_pipeline

    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    given = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas()
    given = given[[any(c.isalpha() for c in t or "") for t in given.text]].sort_values("doc_id")
    seen: dict = {}
    for i, t in zip(given.doc_id, given.text):
        seen.setdefault(SPACES.sub(" ", t), (i, t))
    ids, texts = zip(*sorted(seen.values()))
    classes = plain_classes(texts)
    want = {ids[k] for k, (_, root) in classes.items() if root == k}
    assert set(out.doc_id) == want and (out.n_tokens == out.ids.map(len)).all()


def plain_positions(ids_by_source, block=16):
    """position of each id, by earliest deadline first over as many slots as it takes."""
    key = lambda s: "" if s is None else "=" + s
    root = {key(s): int(len(ids) ** 0.5 * 1000) for s, ids in ids_by_source.items()}
    quota = {s: max(1, r * mixing.PARTS // sum(root.values())) for s, r in root.items()}
    resolution = sum(quota.values())
    left = {key(s): sorted(ids, key=lambda i: (hashlib.md5(f"mix|{i}".encode()).hexdigest(), i)) for s, ids in ids_by_source.items()}
    done, out, slot = dict.fromkeys(quota, 0), {}, 0
    while any(left.values()):
        due = [(-(-(done[s] + 1) * resolution // q), s) for s, q in quota.items() if done[s] * resolution // q <= slot]
        if due:
            s = min(due)[1]
            done[s] += 1
            for place, i in enumerate(left[s][:block]):
                out[i] = slot * block + place
            left[s] = left[s][block:]
        slot += 1
    return out


def test_pipeline_carries_the_mix(spark):
    import corpus_pipeline

    rows = [(i, "big" if i % 3 else None if i % 2 else f"s{i % 7}") for i in range(1500)]
    given = spark.createDataFrame([(i, f"word {i}", "en", s, 9) for i, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.tokens(spark, corpus_pipeline.mix(spark, given, ""), "").toPandas()
    by_source: dict = {}
    for i, s in rows:
        by_source.setdefault(s, []).append(i)
    assert dict(zip(out.doc_id, out.position)) == plain_positions(by_source)


def test_language_filters_equal_plain_counts(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang", "text").collect() if r.lang and r.text][:60]
    rows += [rows[0]] * 5  # repeated rows count once
    df = spark.createDataFrame(rows)
    learned = language_id.fit(df, per_language=9, grams=700)
    hashed = {r.doc_id: r.h for r in df.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}

    def pieces(text):
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        folded = language_id.fold(data, np.array([0, len(data)]))[0].tobytes()
        return [folded[k : k + n] for n in language_id.SIZES for k in range(len(folded) - n + 1)]

    counts = {}
    for lang in {r.lang for r in rows}:
        for r in sorted({r for r in rows if r.lang == lang}, key=lambda r: (hashed[r.doc_id], r.doc_id))[:9]:
            counts.setdefault(lang, Counter()).update(pieces(r.text))
    rate = {g: {lang: c[g] / c.total() for lang, c in counts.items() if c[g] >= language_id.LEAST} for c in counts.values() for g in c}
    number = lambda g: int.from_bytes(bytes([len(g)]) + g, "big")
    wanted = {}
    for lang in counts:
        own = [(-v[lang], number(g)) for g, v in rate.items() if lang in v and v[lang] >= language_id.SHARE * max(v.values())]
        wanted[lang] = {g for _, g in sorted(own)[:700]}
    plain = language_id.Filters.build({lang: np.array(sorted(g), dtype=np.uint64) for lang, g in wanted.items()})
    assert plain.languages == learned.languages and all((a == b).all() for a, b in zip(plain.slots, learned.slots))
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(df, learned).withColumnRenamed("id", "doc_id").collect()}
    size = len(plain.slots[0])
    for r in rows:
        grams = pieces(r.text)
        found = Counter()
        for g in grams:
            at = [int(p[0]) for p in language_id.probes(np.array([number(g)], dtype=np.uint64), size)]
            mask = int(np.bitwise_and.reduce(plain.slots[0][at]))
            found.update(k for k in range(len(plain.languages)) if mask >> k & 1)
        true = [max(0, (found[k] - len(grams) * plain.false[k]) / (1 - plain.false[k])) for k in range(len(plain.languages))]
        best = max(range(len(true)), key=lambda k: (true[k], -k))
        if any(c.isalpha() for c in r.text):
            assert got[r.doc_id][0] == plain.languages[best] and got[r.doc_id][1] == pytest.approx(min(1, max(0, true[best] / max(1, len(grams)))))
