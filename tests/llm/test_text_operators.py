"""Quality rules, fingerprints, BPE, token counts and ORC output against brute force."""

import hashlib
import random
import struct
import zlib

import pyarrow as pa
import pytest
from hinoki.llm import bpe, order_minhash, pretokens, quality, queries, token_count, token_orc
from hinoki.llm.queries import vocabulary
from hinoki.llm.scratch import Scratch
from pyspark.sql import functions as F

from .util import SCHEMA, SF, awkward_rows, coverage, edited, prose, quality_row, rows_of


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select(*[c.split()[0] for c in SCHEMA.split(", ")]).union(spark.createDataFrame([(100_000 + r[0], *r[1:]) for r in awkward_rows()], SCHEMA))


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_quality(spark, docs, texts):
    for r in quality.quality(docs.select("doc_id", "text")).collect():
        want = quality_row(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == want, r["doc_id"]
        assert r["kept"] == (not want[-1] and coverage(texts[r["doc_id"]], quality.COVERAGE, quality.LINE_COVERAGE, quality.SYMBOLS_PER_WORD)), r["doc_id"]


def test_quality_keeps_labelled_good(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").dropDuplicates(["doc_id"])
    rate = dict(rows_of(quality.quality(docs.select("doc_id", "text")).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("double")))))
    assert rate[1] > 0.97 and rate[0] < 0.5, rate


def test_quality_clashing_names_and_empty(spark):
    df = spark.createDataFrame([(1, "word " * 5, 9)], "n_words long, text string, KEPT long")
    assert quality.quality(df).first()["n_words"] == 5
    both = quality.quality(df, prefix="q_").first()
    assert (both["n_words"], both["q_n_words"], both["KEPT"]) == (1, 5, 9)
    assert quality.keep_good(df).columns == df.columns
    assert quality.quality(df.limit(0)).count() == 0


def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def packed(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def test_bpe_matches_library(docs, texts):
    lib = library("word_bpe_49k.json")
    got = {r["doc_id"]: r for r in bpe.encode_decode(docs, vocabulary("word_bpe_49k.json"), with_ids=True).collect()}
    for i, t in texts.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert list(got[i]["ids"]) == ids and got[i]["n_tokens"] == len(ids), i
        assert got[i]["ids_sha256"] == hashlib.sha256(packed(ids)).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest(), i


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_random_strings(name):
    lib, own, rng = library(name), bpe.bpe_file(vocabulary(name)), random.Random(1)
    pools = ["abcde the in 's'll 12", "éèßöÄÜñ ıİſ\u0301\u0300", " \t\n\r\x0b\x0c\x1c\x1d\x85\xa0\u2003\u3000", "ΑΣσςЖж日本語テ😀\u200b", "#|<>!?.,-_'\"", "".join(chr(c) for c in range(1, 0x250))]
    for _ in range(3000):
        pool = rng.choice(pools) + rng.choice(pools)
        t = "".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))
        ids = lib.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False), repr(t)


def test_token_counts(docs, texts):
    lib = library("byte_bpe_50k.json")
    for r in token_count.count_tokens(docs, vocabulary("byte_bpe_50k.json")).collect():
        t = texts[r["doc_id"]] or ""
        n = len(lib.encode(t, add_special_tokens=False).ids)
        assert tuple(r)[1:] == (len(t.encode()), n, n > 512), r["doc_id"]


def test_whole_tokens_are_all_single_pre_tokens_of_one_token():
    file, lib = bpe.bpe_file(vocabulary("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    whole = token_count.whole_tokens(file)
    texts = []
    for s in file.vocab:
        try:
            t = bytes(file.byte_of[c] for c in s).decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if len(lib.pre_tokenizer.pre_tokenize_str(t)) == 1 and t not in file.added:
            texts.append(t)
    single = {t for t, e in zip(texts, lib.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1}
    assert len(texts) > 45_000 and single == whole.keys() & set(texts)


def test_token_orc(spark, docs, texts):
    lib, path = library("byte_bpe_50k.json"), Scratch(spark, "t").path("orc")
    token_orc.write_tokens(docs, path, vocabulary("byte_bpe_50k.json"), 2)
    start, want = 0, []
    for i in sorted(texts):
        ids = [*lib.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(packed(ids))))
        start += len(ids)
    assert sorted(rows_of(token_orc.token_index(spark, path))) == want
    some = token_orc.read_tokens(spark, path, [100_003, 5])
    assert sorted(r["doc_id"] for r in some.collect()) == [5, 100_003]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_orc_cuts_at_spaces_as_the_library(name):
    path, draw = vocabulary(name), random.Random(7)
    file = bpe.bpe_file(path)
    bits = [" ", " ", "  ", "\n", "\t", "a", "Bc", "7", "é", "ß", "'s", "'", ".", "!!", "\u3000", "\xa0", "\u0301", "漢", "\u200b", "\x1c", "\x85", "🙂", "\u180e"]
    for k in range(1500):
        text = "".join(draw.choices(bits, k=draw.randrange(30))) + "<|endoftext|>" * (k % 50 == 0)
        ids = file.library.encode(text, add_special_tokens=False).ids
        assert token_orc.library_ids(file, path, [text], 2) == [struct.pack(f"<{len(ids) + 1}I", *ids, 2)], repr(text)


def test_line_breaks_cut_what_is_remembered():
    from hinoki.llm.process import process_cache

    path = vocabulary("byte_bpe_50k.json")
    file, rng = bpe.bpe_file(path), random.Random(5)
    process_cache().files.pop(("library", path), None)
    for _ in range(400):
        text = "".join(rng.choice(["\n", "\n", " ", "the.", "Über", "it's", "\t", "\r\n", "12", "&&", "\x1c", "\x85", "\u2028", "東", "e\u0301", "'"]) for _ in range(rng.randint(1, 9)))
        ids = file.library.encode(text, add_special_tokens=False).ids
        assert token_orc.library_ids(file, path, [text], 2) == [struct.pack(f"<{len(ids) + 1}I", *ids, 2)], repr(text)
    token_orc.library_ids(file, path, ["so end.\nNext one&&\nlast"], 2)
    _, runs = process_cache().files["library", path]
    assert "end." in runs and "\nNext" in runs and not any("\n" in r[1:] for r in runs)


@pytest.mark.parametrize("most", [60, 400_000])
def test_token_orc_batches_as_the_library(monkeypatch, most):
    """Batches of any texts, also when what is remembered is full again and again."""
    from hinoki.llm.process import process_cache

    path = vocabulary("byte_bpe_50k.json")
    file, rng = bpe.bpe_file(path), random.Random(most)
    monkeypatch.setattr(pretokens, "REMEMBERED", most)
    process_cache().files.pop(("remembered", path, 2), None)
    latin = ["\n", "\n", " ", " ", "  ", "\t", "\r\n", "\x0b", "the.", "Über", "it's", "'s", "'re", "'ll", "'d", "'x", "'", "''", " '", "s", "12", "²", "½", "&&", "×", "\x00", "\x7f", "—", "⁞", "ª", "ɏ", "7" * 250]
    other = ["\x1c", "\x85", "\xa0", "\u2003", "\u2028", "東", "e\u0301", "ɐ", "😀", "<|endoftext|>", "<|end"]
    for size in [0, 1, 2, 300, 300, 300]:
        texts = [None if rng.random() < 0.03 else "".join(rng.choices(latin if rng.random() < 0.8 else latin + other, k=rng.randrange(14))) for _ in range(size)]
        got = token_orc.encoded(file, path, pa.array(["left out", *texts], pa.string()).slice(1), 2)
        assert got.to_pylist() == [[*file.library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
    edges = ("", "a", "1", " ", "\n", ".")
    texts = [a + chr(c) + b for c in [*range(0x255), *range(0x200C, 0x2064)] for a in edges for b in edges]
    got = token_orc.encoded(file, path, pa.array(texts), 2).to_pylist()
    assert got == [[*file.library.encode(t, add_special_tokens=False).ids, 2] for t in texts]


def test_pretokens_meet_the_library_once(monkeypatch):
    """Marks don't make other strings of words, and a batch asks for each of its pre-tokens once."""
    path = vocabulary("byte_bpe_50k.json")
    memo, asked = pretokens.Remembered(bpe.bpe_file(path), 2), []
    monkeypatch.setattr(pretokens, "remembered", lambda *a: memo)
    monkeypatch.setattr(memo, "_encode", lambda words, encode=memo._encode: asked.extend(words) or encode(words))
    for _ in range(2):
        lists, usual = pretokens.encoded(bpe.bpe_file(path), path, pa.array([f"one thaneon{m} thaneon\nthaneon{m}" for m in ("", ".", ",", ";", "...")]), 2)
    assert usual.all() and len(lists) == 5
    assert sorted(asked) == sorted(["one", " thaneon", "thaneon", "\n", ".", ",", ";", "..."])


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 16, 17, 40])
def test_range_numbers(spark, n):
    from bisect import bisect_left

    from hinoki.llm import ranges

    cuts = [3 * i + 1 for i in range(n)]
    got = spark.createDataFrame([(i,) for i in [None, *range(-2, 3 * n + 5)]], "x long").select("x", ranges.number(F.col("x"), cuts).alias("r")).collect()
    assert all(r["r"] == (0 if r["x"] is None else bisect_left(cuts, r["x"])) for r in got)


def test_token_orc_files(spark, tmp_path):
    """What the footers say: row index, Bloom filter, several stripes; and that a filter on ids reads fewer rows."""
    from pyarrow import orc

    rows = [(i, " ".join(str((i * 7919 + k * k) % 100_003) for k in range(60))) for i in range(12_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    old = token_orc.STRIPE_BYTES
    token_orc.STRIPE_BYTES = 256 << 10
    try:
        token_orc.write_tokens(df, f"file://{tmp_path}/orc", vocabulary("byte_bpe_50k.json"), 2)
    finally:
        token_orc.STRIPE_BYTES = old
    files = [orc.ORCFile(str(f)) for f in (tmp_path / "orc").glob("*.orc")]
    assert sum(f.nrows for f in files) == len(rows) and max(f.nstripes for f in files) > 1
    assert all(f.row_index_stride == token_orc.STRIDE for f in files)
    reader = spark._jvm.org.apache.orc.OrcFile
    for f in (tmp_path / "orc").glob("*.orc"):
        r = reader.createReader(spark._jvm.org.apache.hadoop.fs.Path(str(f)), reader.readerOptions(spark._jsc.hadoopConfiguration()))
        kinds = {str(s.getKind()) for k in range(r.getStripes().size()) for s in r.rows().readStripeFooter(r.getStripes().get(k)).getStreamsList()}
        encodings = {str(e.getKind()) for k in range(r.getStripes().size()) for e in r.rows().readStripeFooter(r.getStripes().get(k)).getColumnsList()}
        assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds and "DIRECT_V2" in encodings
    # The rows that the scan hands over, before the filter that Spark keeps above it.
    some = token_orc.read_tokens(spark, f"file://{tmp_path}/orc", [7])
    assert [r["doc_id"] for r in some.collect()] == [7]
    scan = some._jdf.queryExecution().executedPlan()
    while scan.children().size():
        scan = scan.children().head()
    metric = scan.metrics().get("numOutputRows").get().value()
    assert 0 < metric <= 2 * token_orc.STRIDE


def test_token_orc_repeats_nulls_empty(spark):
    path = Scratch(spark, "t").path("orc")
    df = spark.createDataFrame([(2, "b", 1), (None, "x y", 2), (2, "a", 3), (2, "a", 4), (1, None, 5)], "doc_id long, text string, pos long")
    token_orc.write_tokens(df, path, vocabulary("byte_bpe_50k.json"), 2)
    rows = sorted(rows_of(token_orc.token_index(spark, path)), key=lambda r: r[1])
    assert [(r[0], r[1], r[2]) for r in rows] == [(None, 0, 3), (1, 3, 1), (2, 4, 2), (2, 6, 2), (2, 8, 2)]
    path = Scratch(spark, "t").path("orc")
    token_orc.write_tokens(df.limit(0), path, vocabulary("byte_bpe_50k.json"), 2)
    assert token_orc.token_index(spark, path).count() == 0


def omh_likeness_naive(a, b, k=6):
    return order_minhash.likeness(*(order_minhash.signature(order_minhash.points_of(t)) for t in (a, b)))


@pytest.mark.parametrize("parts", [1, 5])
def test_fingerprints(docs, texts, parts):
    ids = sorted(texts, reverse=True)
    got = {r["doc_id"]: r for r in order_minhash.fingerprints(docs, parts=parts).collect()}
    assert len(got) == len(texts)
    sig = lambda t: order_minhash.signature(order_minhash.points_of(t))
    for at, i in enumerate(ids):
        own, nxt = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        cut = len(own) // 2
        new = own[: len(own) - cut] + nxt[:cut]
        r = got[i]
        assert r["n_chars"] == len(own)
        assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
        assert r["fingerprint"] == sig(own).astype(">u4").tobytes().hex()
        assert r["edited_fingerprint"] == sig(new).astype(">u4").tobytes().hex()
        assert r["near_edited"] == order_minhash.likeness(sig(own), sig(new))
        assert r["near_next"] == order_minhash.likeness(sig(own), sig(nxt))


def naive_signature(text, k, sketches, keep):
    """Selection by a plain sort over all numbered k-mers."""
    h = order_minhash.numbered_kmers(order_minhash.points_of(text), k)
    out = []
    for j in range(sketches):
        v = [(((int(x) * int(order_minhash._MULTIPLIERS[j])) % 2**64), i) for i, x in enumerate(h)]
        v = sorted((a ^ (a >> 32), i) for a, i in v)
        out.append(tuple(int(h[i]) for _, i in sorted(v[:keep], key=lambda p: p[1])))
    return out


def plain_mix(x):
    x ^= x >> 31
    x = x * 0x7FB5D329728EA185 % 2**64
    x ^= x >> 27
    x = x * 0x81DADEF4BC2DD44D % 2**64
    return x ^ (x >> 33)


def plain_signature(text, k=6, sketches=24, keep=2):
    """Numbered k-mers and their selection in plain integers, one k-mer and one sketch at a time."""
    points, roll, seen, hashes = [ord(c) + 1 for c in text], 0x9FB21C651E98DF25, {}, []
    k = min(k, len(points))
    for i in range(len(points) - k + 1 if points else 0):
        h = 0
        for p in points[i : i + k]:
            h = (h * roll + p) % 2**64
        h = plain_mix((h + k) % 2**64)
        number = seen[h] = seen.get(h, -1) + 1
        hashes.append(plain_mix((h + number * 0xA0761D6478BD642F) % 2**64) if number else h)
    out = []
    for j in range(sketches):
        ranked = []
        for i, h in enumerate(hashes):
            v = h * (plain_mix((j + 1) * 0xD1342543DE82EF95 % 2**64) | 1) % 2**64
            ranked.append((v ^ (v >> 32), i))
        t = j + 1
        for i in sorted(i for _, i in sorted(ranked)[:keep]):
            t = plain_mix((t * roll + hashes[i]) % 2**64)
        out.append(t >> 32 if hashes else 0)
    return out


@pytest.mark.parametrize("k, sketches, keep", [(6, 24, 2), (6, 64, 2), (4, 5, 3)])
def test_signature_is_that_of_a_plain_version(k, sketches, keep):
    rng = random.Random(k)
    for n in (0, 1, 2, 5, 7, 60, 500, 2500):
        text = "".join(rng.choice("abcdé日😀 ") for _ in range(n))
        assert order_minhash.signature(order_minhash.points_of(text), k, sketches, keep).tolist() == plain_signature(text, k, sketches, keep)


def test_signature_selects_minima():
    rng = random.Random(4)
    for n in (1, 3, 40, 400, 3000):
        a = "".join(rng.choice("abcd ") for _ in range(n))
        b = edited(rng, a, 0.1)
        want = sum(x == y for x, y in zip(naive_signature(a, 6, 24, 2), naive_signature(b, 6, 24, 2))) / 24
        assert omh_likeness_naive(a, b) == want


def test_fingerprint_orders_by_edit_distance():
    rng = random.Random(9)
    a = prose(rng, 400)
    w = a.split(" ")
    little, much = edited(rng, a, 0.02), edited(rng, a, 0.4)
    moved = " ".join(w[200:] + w[:200])
    near = lambda x: omh_likeness_naive(a, x)
    assert near(a) == 1 and near(little) > near(much) and near(moved) < 1 and near(prose(rng, 400)) < 0.1


def test_numbered_kmers_are_distinct_in_order():
    h = order_minhash.numbered_kmers(order_minhash.points_of("abcabcabcabc"), 3)
    assert len(set(h.tolist())) == len(h) == 10
    assert h[0] == order_minhash.numbered_kmers(order_minhash.points_of("abc"), 3)[0]


def test_query_sees_texts_that_keep_their_first_half(spark):
    rows = queries.op4_order_minhash(spark, "/root/testdata/sf0.01").filter("n_chars between 50 and 20000").collect()
    assert len(rows) > 500 and sum(r["near_edited"] == 0 for r in rows) <= 0.005 * len(rows)


def test_fingerprints_edges(spark):
    one = spark.createDataFrame([(5, "solo", 1)], "doc_id long, text string, part long")
    r = order_minhash.fingerprints(one).first()
    assert r["near_next"] == 1.0 and r["edited_sha256"] == hashlib.sha256(b"soso").hexdigest()
    assert order_minhash.fingerprints(one.limit(0)).count() == 0
    rows = spark.createDataFrame([(1, "b"), (1, "a"), (None, "n"), (2, None), (1, "a")], "doc_id long, text string")
    assert sorted(str(x[0]) for x in order_minhash.fingerprints(rows, parts=3).collect()) == ["1", "1", "1", "2", "None"]


@pytest.mark.parametrize("op", [lambda d: bpe.encode_decode(d, vocabulary("word_bpe_49k.json")), lambda d: token_count.count_tokens(d, vocabulary("byte_bpe_50k.json"))])
def test_narrow_operators_edges(spark, op):
    df = spark.createDataFrame([(1, "a", 3), (1, "a", 3), (None, None, 4)], "doc_id long, text string, n_tokens long")
    assert sorted((str(r["doc_id"]), r["n_tokens"]) for r in op(df).collect()) == [("1", 1), ("1", 1), ("None", 0)]
    assert op(df.limit(0)).count() == 0
