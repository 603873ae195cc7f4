"""Goldens and properties of the analyzer."""

import json
import os
import random
import shutil
import time
import warnings

import duckdb
import numpy as np
import pytest
from hinoki.functions import charclass, counters, definitions, formats, normalize, numerals, sentences
from hinoki.functions.charclass import BITS, Categories
from hinoki.operators import lattice, relational
from hinoki.operators.lattice import CategoryOov, Chars, CounterOov, JoinKatakana, JoinNumeric, RegexOov, SimpleOov
from hinoki.operators.plugins import ConnectionEdit, OovProvider
from hinoki.operators.tokenize import FIELDS, Engine, morphemes
from hinoki.plans import config, queries, rule_queries  # noqa: F401
from hinoki.plans.config import NOUN, Config
from hinoki.plans.dictionary import Compiled, Dictionary, PosMatcher, Word, edit_connections, encoded, length_mask
from hinoki.sources import lexicon as src
from hinoki.streaming.sentence_stream import complete, sentence_stream
from pyspark.sql import functions as F


def compiled(words, matrix=None):
    """A dictionary of (surface, cost, pos) or (surface, left, right, cost, pos) entries."""
    pos, by_id, index = [], {}, {}
    for i, w in enumerate(words):
        surface, left, right, cost, p = w if len(w) == 5 else (w[0], 0, 0, w[1], w[2])
        p = tuple((p.split(",") + ["*"] * 6)[:6])
        if p not in pos:
            pos.append(p)
        by_id[i] = Word(0, i, left, right, cost, surface, len(surface), pos.index(p), surface, surface, surface)
        index.setdefault(surface, []).append(by_id[i])
    return Compiled(by_id, index, np.zeros((1, 1), np.int16) if matrix is None else matrix, pos)


@pytest.fixture(scope="module")
def engine(spark):
    return queries.demo_engine(spark)


def surfaces(e, text, mode="C"):
    return [m["surface"] for m in e.tokenize(text, mode)]


@pytest.mark.parametrize("text, eos", [("あいう。えお。", 4), ("あいうえお", -5), ("あいう。。えお。", 5), ("3.141", -5), ("あ（いう）。えお", 6), ("あ（いう。え）お", -8), ("あいう?)えお", 5), ("1.と2.が。", 7), ("あいう?の?です。", 4), ("", 0), ("あいう<br><br>えお", 11)])
def test_sentence_boundary(text, eos):
    assert sentences.find_eos(text) == eos


@pytest.mark.parametrize("text, eos", [("あい うえお", -3), ("あ い うえお", -4), ("あいうえお。", -5)])
def test_sentence_limit(text, eos):
    assert sentences.find_eos(text, limit=5) == eos


def test_parentheses(spark):
    assert sentences.paren_level("（（あいうえお") == 2 and sentences.paren_level("あいうえお））") == 0
    df = spark.createDataFrame([("（（あ）",), ("あ））（",), ("",)], "t string")
    assert [r[0] for r in df.select(sentences.paren_level_column(F.col("t"))).collect()] == [1, 1, 0]
    df = spark.createDataFrame([("。」あ",), ("あ。",)], "t string")
    assert [r[0] for r in df.select(sentences.prohibited_column(F.col("t"))).collect()] == [2, 0]


def test_split_loses_no_text():
    rng = random.Random(0)
    for _ in range(300):
        t = "".join(rng.choice("あい。（）「」 \n?!1.,と") for _ in range(rng.randint(0, 60)))
        spans = list(sentences.split(t, limit=rng.choice((5, 20, 4096))))
        covered = set(i for a, b in spans for i in range(a, b))
        assert all(t[i].isspace() for i in range(len(t)) if i not in covered)
        assert all(a2 >= b1 for (_, b1), (a2, _) in zip(spans, spans[1:]))


@pytest.mark.parametrize("text, want", [("千三百二十七万一四.〇五", "13270014.05"), ("1.5百万1.5千20", "1501520"), ("2,000,000", "2000000"), ("6.0", "6"), ("00.1000", "00.1"), ("2,4", "COMMA"), ("6.", "POINT"), ("億万", "OTHER"), ("1234567890123456789012345", "1234567890123456789012345"), ("二百", "200"), ("十", "10"), (".5", "POINT"), ("1..2", "POINT"), ("0,000", "COMMA"), ("12,345.6", "12345.6"), ("一億二千万", "120000000"), ("x", "OTHER")])
def test_numerals(text, want):
    ok, norm, error = numerals.parse(text)
    assert (norm if ok else error) == want


def test_normalization_and_offsets():
    chain = [normalize.DefaultRewrite(frozenset("ⅷ"), {"か゛": "が"}), normalize.ProlongedMarks(), normalize.StripRuby()]
    t = normalize.normalized("ＡＢｃか゛ー〜ーⅧ㍿漢字(かんじ)", chain)
    assert t.text == "abcがーⅷ株式会社漢字"
    assert t.origin[t.text.index("漢")] == 10 and t.origin[-1] == len("ＡＢｃか゛ー〜ーⅧ㍿漢字(かんじ)")
    assert len(t.origin) == len(t.text) + 1 and t.origin == sorted(t.origin)
    assert normalize.normalized("Hello World", chain).text == "hello world"
    e = normalize.Edited("abcdef")
    e.replace(1, 4, "xy")
    assert (e.text, e.origin) == ("axyef", [0, 1, 4, 4, 5, 6])
    for bad in ((-1, 2), (9, 10), (3, 2)):
        with pytest.raises(IndexError):
            e.replace(*bad, "z")
    with pytest.raises(ValueError):
        e.replace(2, 2, "z")
    assert e.substring(1, 3) == "xy"
    with pytest.raises(IndexError):
        e.substring(1, 9)
    with pytest.raises(ValueError, match="surrogate"):
        normalize.normalized("a\ud800b", chain)


def test_rewrite_file():
    r = normalize.DefaultRewrite.from_lines(["# c", "Ⅰ", "ｶﾞ ガ", ""])
    assert r.ignore == {"Ⅰ"} and r.replacements == {"ｶﾞ": "ガ"}
    with pytest.raises(ValueError):
        normalize.DefaultRewrite.from_lines(["a b c"])


def test_categories():
    c = Chars.of("ABC123あア漢一", Categories())
    assert c.runs == [3, 2, 1, 3, 2, 1, 1, 1, 2, 1]
    assert c.begins == [True, False, False] + [True] * 7
    assert Categories().mask("〇") == BITS["KANJI"] | BITS["SYMBOL"] | BITS["KANJINUMERIC"]
    assert Categories([]).mask("A") == BITS["DEFAULT"]
    ranges, rules = charclass.parse_char_definition(["# x", "ALPHA 1 1 0", "0x0041..0x005A ALPHA # letters", "0x0020 SPACE"])
    assert ranges == [(65, 90, 32), (32, 32, 2)] and rules == {"ALPHA": (True, True, 0)}
    for bad in (["0x5..0x1 ALPHA"], ["0x41 WHAT"], ["ALPHA 1 1 0", "ALPHA 1 1 0"]):
        with pytest.raises(ValueError):
            charclass.parse_char_definition(bad)


def test_simple_oov_splits_single_characters():
    e = Engine(compiled([("です", 100, "助動詞")]), oov=[SimpleOov(NOUN, register=True)], input=())
    assert surfaces(e, "です\nです") == ["です", "\n", "です"]
    assert surfaces(e, "xyzxyz") == ["xyzxyz"] and e.tokenize("") == []


def test_category_oov():
    cats = {"NUMERIC": (True, True, 0), "HIRAGANA": (False, True, 2)}
    rules = [("NUMERIC", 0, 0, 100, NOUN), ("HIRAGANA", 0, 0, 500, NOUN)]
    e = Engine(compiled([("あ", 9000, "名詞")]), oov=[CategoryOov(cats, rules, True), SimpleOov(NOUN, register=True)])
    assert surfaces(e, "123いうえ") == ["123", "いうえ"]
    c = Chars.of("いうえ", Categories())
    assert [n.end for n in e.oov[0].provide(c, 0, set())] == [3, 1, 2]
    assert e.oov[0].provide(c, 0, {1}) == []


def test_regex_oov():
    d = compiled([("京都", 100, "名詞,固有名詞"), ("東京", 100, "名詞,固有名詞")])
    e = Engine(d, oov=[RegexOov(r"[0-9a-z-]+", NOUN, cost=3500, register=True), SimpleOov(NOUN, register=True)])
    assert surfaces(e, "京都xag-2f東京") == ["京都", "xag-2f", "東京"]
    c = Chars.of("abc", Categories())
    assert e.oov[0].provide(c, 0, {3}) == [] and e.oov[0].provide(c, 1, set()) == []


def test_counter_aliases():
    d = compiled([("りんご", 100, "名詞"), ("を", 100, "助詞"), ("個", 100, "接尾辞,名詞的,助数詞"), ("1", 100, "名詞,数詞"), ("ください", 100, "動詞"), ("。", 10, "補助記号"), ("回", 10, "接尾辞,名詞的"), ("階", 10, "接尾辞,名詞的")])
    e = Engine(d, oov=[CounterOov(), SimpleOov(NOUN, register=True)])
    ms = e.tokenize("りんごを1こください。")
    assert [m["surface"] for m in ms] == ["りんご", "を", "1", "こ", "ください", "。"] and ms[3]["normalized_form"] == "個" and ms[3]["is_oov"]
    c = Chars.of("1かい", Categories())
    assert [n.word.normalized for n in e.oov[0].provide(c, 1, set())] == ["回", "階"]
    assert e.oov[0].provide(Chars.of("あかい", Categories()), 1, set()) == []


def test_neko():
    d = compiled([("ね", 1, "助詞,終助詞"), ("こと", 1, "名詞"), ("ねこ", 5000, "名詞"), ("と", 5000, "助詞,格助詞")])
    assert surfaces(Engine(d, oov=[SimpleOov(NOUN, register=True)]), "ねことね") == ["ねこ", "と", "ね"]


def test_join_numeric():
    digits = [(x, 100, "名詞,数詞,*,*,*,*") for x in "0123456789一二三十百千万"] + [(x, 100, "補助記号") for x in ".,"] + [("円", 100, "名詞")]
    e = Engine(compiled(digits), oov=[SimpleOov(NOUN, register=True)], path=[JoinNumeric()])
    norm = lambda t: [m["normalized_form"] for m in e.tokenize(t)]
    assert norm("123円20銭") == ["123", "円", "20", "銭"]
    assert norm("三千二百円") == ["3200", "円"]
    assert norm("2,00") == ["2", ",", "00"]
    assert norm("6.") == ["6", "."]
    assert norm("1.5.") == ["1.5", "."]


def test_join_katakana():
    e = Engine(compiled([("アイ", 100, "名詞"), ("ウエオ", 100, "名詞")]), oov=[SimpleOov(NOUN, register=True)], path=[JoinKatakana(NOUN, register=True)])
    ms = e.tokenize("アイウエオカ")
    assert [m["surface"] for m in ms] == ["アイウエオカ"] and ms[0]["is_oov"]
    assert surfaces(Engine(compiled([("アイウ", 100, "名詞"), ("エオカ", 100, "名詞")]), oov=[SimpleOov(NOUN, register=True)], path=[JoinKatakana(NOUN, register=True)]), "アイウエオカ") == ["アイウ", "エオカ"]


def test_ties_go_to_the_first_inserted():
    d = compiled([("あ", 10, "名詞,一"), ("あ", 10, "名詞,二"), ("い", 5, "名詞"), ("あい", 15, "名詞,三")])
    ms = Engine(d, oov=[SimpleOov(NOUN, register=True)]).tokenize("あい")
    assert [m["word_id"] for m in ms] == [0, 2] or [m["word_id"] for m in ms] == [3]
    lat = lattice.build(d, Chars.of("あ", Categories()), [])
    assert lat.path()[0].word.word_id == 0


def test_inhibited_connection():
    matrix = np.zeros((2, 2), np.int16)
    matrix[1, 1] = 32767
    d = compiled([("あ", 1, 1, 1, "名詞"), ("い", 1, 1, 1, "名詞"), ("あい", 0, 0, 9000, "名詞")], matrix)
    assert surfaces(Engine(d, oov=[SimpleOov(NOUN, register=True)]), "あい") == ["あい"]


def brute_total(d, c, oov):
    """Cheapest of all segmentations, by recursion over candidate nodes."""
    def nodes(at):
        found = [(at + w.length, w) for w in d.prefixes(c.text, at) if at + w.length == len(c.text) or c.begins[at + w.length]]
        seen = {e - at for e, _ in found}
        return found + [(n.end, n.word) for p in oov for n in p.provide(c, at, seen)]

    def go(at, right):
        if at == len(c.text):
            return d.connect(right, 0)
        totals = []
        for end, w in nodes(at):
            rest = go(end, w.right_id)
            if rest is not None and d.connect(right, w.left_id) != 32767:
                totals.append(d.connect(right, w.left_id) + w.cost + rest)
        return min(totals, default=None)

    return go(0, 0)


def test_kernel_equals_brute_force_and_relational(spark):
    rng = random.Random(8)
    matrix = np.array([[rng.randint(-200, 200) for _ in range(3)] for _ in range(3)], np.int16)
    matrix[1, 2] = 32767
    words = [("".join(rng.choice("あいう") for _ in range(rng.randint(1, 3))), rng.randrange(3), rng.randrange(3), rng.randint(-100, 900), "名詞") for _ in range(14)]
    d = compiled(words, matrix)
    oov = [SimpleOov(("名詞", *"*****"), cost=1500)]
    oov[0].set_up(d)
    texts = ["".join(rng.choice("あいう") for _ in range(rng.randint(1, 8))) for _ in range(25)]
    totals = []
    for t in texts:
        c = Chars.of(t, Categories())
        want = brute_total(d, c, oov)
        if want is None:
            with pytest.raises(ValueError):
                lattice.build(d, c, oov).path()
        else:
            lat = lattice.build(d, c, oov)
            lat.path()
            assert lat.total == want
        totals.append(want)
    lex = spark.createDataFrame([(w.dict_id, w.word_id, w.surface, w.left_id, w.right_id, w.cost, w.surface, 0) for w in d.words.values()], "dict_id int, word_id int, headword string, left_id int, right_id int, cost int, surface string, pos_id int")
    conn = spark.createDataFrame([(a, b, int(matrix[a, b])) for a in range(3) for b in range(3)], "left int, right int, cost int")
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    nodes = relational.lattice_nodes(df, lex, "k", 3, 1500, 0)
    assert dict((r[0], r[1]) for r in relational.viterbi(nodes, conn, "k").collect()) == dict(enumerate(totals))


def test_lattice_tables_stay_within_rows(spark):
    """Nodes and edges come without sorting or dealing out characters, as the kernel makes them."""
    words = [("the", 1, 2, 700, "名詞"), ("the", 2, 1, 800, "名詞"), ("th", 1, 1, 10, "名詞"), ("あ", 0, 1, 5, "名詞"), ("あい", 1, 1, 7, "名詞"), ("い", 2, 0, 9, "名詞")]
    d, oov = compiled(words, np.zeros((3, 3), np.int16)), SimpleOov(("名詞", *"*****"), cost=1500)
    oov.set_up(d)
    texts = ["the あいい the", "", None, "い", "thethe い", "\n😀あ", "あい" * 40]
    nodes_want, edges_want = [], []
    for k, t in enumerate(texts):
        made = sorted(lattice.build(d, Chars.of(t, Categories()), [oov]).nodes(), key=lambda n: (n.begin, n.is_oov, n.end, n.word.word_id)) if t else []
        nodes_want += [(k, n.begin, n.end, n.word.surface, n.word.cost, n.word.word_id, i) for i, n in enumerate(made, 1)]
        edges_want += [(k, i, j, 0) for i, a in enumerate(made, 1) for j, b in enumerate(made, 1) if a.end == b.begin and (a.word.right_id, b.word.left_id) != (2, 1)]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    lex = spark.createDataFrame([(0, w.word_id, w.surface, w.left_id, w.right_id, w.cost, w.surface, 0) for w in d.words.values()], "dict_id int, word_id int, headword string, left_id int, right_id int, cost int, surface string, pos_id int")
    nodes = relational.lattice_nodes(df, lex, "k", 3, 1500, 0)
    edges = relational.lattice_edges(df, lex, spark.createDataFrame([(2, 1, 32767)], "left int, right int, cost int"), "k", 3)
    assert sorted(map(tuple, nodes.select("k", "at", "end", "surface", "cost", "word_id", "node_ord").collect())) == nodes_want
    assert sorted(map(tuple, edges.collect())) == sorted(edges_want)
    for made in (nodes, edges):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("hashpartitioning", "Window", "SortMergeJoin"))


def _table(tmp_path, texts) -> str:
    import pyarrow as pa
    import pyarrow.parquet as pq

    n = len(texts)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * n, "source": ["a"] * n}), f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_empty_texts_as_in_sql(spark, tmp_path):
    path = _table(tmp_path, ["", None, "ab c", "", "\n"])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet'")
    for name in ("char_category", "can_bow", "category_run", "offset_map", "paren_level"):
        want = con.sql(queries.SQL[name]).fetchall()
        assert sorted(map(repr, map(tuple, queries.QUERIES[name](spark, path).collect()))) == sorted(map(repr, want)), name


def test_chains_of_unknown_words_equal_single_steps(monkeypatch):
    class Stepwise(SimpleOov):
        """Another class, whose nodes are inserted one by one."""

    rng, made = random.Random(4), []
    words = [("the", 100, "名詞"), ("the of", 150, "名詞"), ("o", 5, "名詞"), ("7", 9, "名詞"), ("個", 100, "接尾辞,名詞的,助数詞")]
    for matrix in (np.zeros((1, 1), np.int16), np.full((1, 1), -7, np.int16)):
        for kind in (SimpleOov, Stepwise):
            made.append(Engine(compiled(words, matrix), oov=[CounterOov(), kind(NOUN, register=True)]))
    for _ in range(60):
        text = "".join(rng.choice(["the ", "the of", "off", " ", "xyz", "7", "こ", "あ", "Ж", "\n"]) for _ in range(rng.randint(1, 25)))
        for fast, slow in (made[:2], made[2:]):
            assert fast.tokenize(text) == slow.tokenize(text)
            assert json.loads(fast.dump(text)) == json.loads(slow.dump(text))
    calls = []
    monkeypatch.setattr(SimpleOov, "provide", lambda self, c, at, seen, f=SimpleOov.provide: calls.append(at) or f(self, c, at, seen))
    assert len(made[0].tokenize("abc def ghi jkl")) == 7 and not calls


def test_idle_patterns_leave_chains(monkeypatch):
    class Stepwise(SimpleOov):
        """Another class, whose nodes are inserted one by one."""

    def outcome(e, text):
        try:
            return e.tokenize(text), json.loads(e.dump(text))
        except ValueError as error:  # a pattern may end inside a word
            return str(error)

    rng = random.Random(6)
    words = [("the", 100, "名詞"), ("o", 5, "名詞")]
    for regex, strict, longest in (("(?!)", True, 32), ("[a-z]+(?! )", True, 4), ("[0-9a-z-]+$", False, 3), ("x*", True, 32), ("(?<=7)[a-z ]+", False, 5), ("あ+", True, 0)):
        for own, matrix in (([], np.zeros((1, 1), np.int16)), (words, np.full((1, 1), 9, np.int16))):
            fast, slow = (Engine(compiled(own, matrix), oov=[RegexOov(regex, NOUN, longest=longest, strict=strict, register=True), kind(NOUN, register=True)]) for kind in (SimpleOov, Stepwise))
            for _ in range(40):
                text = "".join(rng.choice(["the ", "off", " ", "xyz", "x-", "7", "あ", "ねこと", "Ж", "\n", "７ａ"]) for _ in range(rng.randint(1, 12)))
                assert outcome(fast, text) == outcome(slow, text), (regex, text)
    calls, never = [], Engine(compiled([]), oov=[RegexOov("(?!)", NOUN, register=True), SimpleOov(NOUN, register=True)])
    monkeypatch.setattr(RegexOov, "provide", lambda self, c, at, seen, f=RegexOov.provide: calls.append(at) or f(self, c, at, seen))
    monkeypatch.setattr(lattice, "Node", lambda *a, f=lattice.Node, **k: calls.append(a) or f(*a, **k))
    texts = [normalize.normalized(x, never.input) for x in ("abc def", "😀あ", "")]
    done = [(t, never.path_of(t.text, "A")) for t in texts]
    made = never.columns(done, ["is_oov", "begin", "end", "surface"], ("bytes",)).to_pylist()
    assert [[(x["begin_bytes"], x["end_bytes"], x["surface"]) for x in m] for m in made] == [[(0, 3, "abc"), (3, 4, " "), (4, 7, "def")], [(0, 4, "😀"), (4, 7, "あ")], []]
    assert all(x["is_oov"] for m in made for x in m) and len(calls) == 2  # the beginnings of two lattices
    with pytest.raises(ValueError, match="not reachable"):
        Engine(compiled([], np.array([[0, 0], [32767, 0]], np.int16)), oov=[SimpleOov(NOUN, 1, 1, register=True)]).tokenize("ab c")


def test_a_subclass_of_the_pattern_is_asked_everywhere():
    class Other(RegexOov):
        def provide(self, c, at, seen):
            return [lattice.Node(at, len(c.text), self.words[c.text[at:]], True)] if at == 1 else []

    assert surfaces(Engine(compiled([]), oov=[Other("(?!)", NOUN, register=True), SimpleOov(NOUN, cost=1, register=True)]), "あいう") == ["あ", "いう"]


def test_category_spans_equal_single_words(spark, tmp_path, monkeypatch):
    texts = ["", "ab 12,5 #%& xy", "東京都に行く", "カタカナとＡＢc", "一二三〇x", "ЖЖα😀 \n\t", "  aé--7"]
    rules = src.parse_unknown_rules(definitions.UNKNOWN_WORDS)
    for categories in (charclass.default_rules(), {k: (i % 2 == 0, i % 3 > 0, i % 4) for i, k in enumerate(charclass.default_rules())}):
        p = CategoryOov(categories, rules, True)
        p.set_up(rule_queries._large())
        for t in texts:
            c = Chars.of(t, Categories())
            want = [(n.begin, n.end, n.word.surface, n.word.left_id, n.word.pos_id) for at in c.starts for n in p.provide(c, at, set())]
            made = [(a, b, w[t[a:b]]) for w, begins, ends in p.spans(c) for a, b in zip(begins.tolist(), ends.tolist())]
            assert sorted((a, b, w.surface, w.left_id, w.pos_id) for a, b, w in made) == sorted(want)
    masks = np.array([random.Random(i).randrange(64) for i in range(300)])
    slow = [next((k for k in range(len(masks) - i + 1) if i + k == len(masks) or not np.bitwise_and.reduce(masks[i : i + k + 1])), 0) for i in range(len(masks))]
    assert charclass.runs(masks).tolist() == slow and charclass.runs([]).tolist() == []
    monkeypatch.setattr(CategoryOov, "provide", None)
    path = _table(tmp_path, [*texts, None])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{path}/documents.parquet' WHERE doc_id IN (1, 6)")
    made = {tuple(r) for r in rule_queries.oov_category(spark, path).collect()}
    assert set(con.sql(queries.SQL["oov_category"]).fetchall()) <= made and len(made) == len(texts) - 1


def test_unknown_words_are_remembered():
    categories = CategoryOov({"DEFAULT": (True, True, 2), "ALPHA": (True, True, 0)}, [("ALPHA", 0, 0, 5, NOUN)], True)
    for p in (SimpleOov(NOUN, register=True), RegexOov("[a-z]+", NOUN, register=True), categories):
        p.set_up(compiled([]))
        a, b = (p.provide(Chars.of("abc", Categories()), 0, set())[0].word for _ in range(2))
        assert a is b and (a.surface, a.length) == ("abc", 3)


def test_offsets_in_all_units_at_once(spark, engine):
    df = spark.createDataFrame([("東😀é",)], "text string").coalesce(1)
    m = engine.tokenize_table(df, fields=["begin", "end", "surface"], offsets=("code points", "utf-16", "bytes")).collect()[0]["morphemes"]
    assert [(x["begin_utf_16"], x["end_code_points"], x["end_utf_16"], x["end_bytes"]) for x in m][-1] == (3, 3, 4, 9)


def test_tables_are_dealt_and_batches_bounded(spark, tmp_path):
    from hinoki.functions import charclass, normalize
    from hinoki.functions.batches import dealt

    spark.range(60).repartition(6).write.parquet(f"{tmp_path}/six")
    cores = spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    six = spark.read.parquet(f"{tmp_path}/six")
    assert cores <= six.rdd.getNumPartitions() < 4 * cores == dealt(six).rdd.getNumPartitions()
    spark.conf.unset("spark.sql.files.openCostInBytes")
    path, rows = _table(tmp_path, ["Ab 12"]), "spark.sql.execution.arrow.maxRecordsPerBatch"
    for f in (lambda: charclass.runs_column(F.col("x")), lambda: normalize.normalize_column(F.col("x"), []), lambda: rule_queries.offset_map(spark, path), lambda: queries.tokenize_documents(spark, path)):
        spark.conf.set(rows, "10000")
        f()
        assert spark.conf.get(rows) == "1000"


def test_counts_have_no_row_for_each_morpheme(spark, tmp_path):
    path = _table(tmp_path, ["the of 12 x", "", None])
    for name in ("tokenize_documents", "oov_rate_by_lang", "morphemes_by_source"):
        plan = queries.QUERIES[name](spark, path)._jdf.queryExecution().executedPlan().toString()
        assert "Generate" not in plan
    assert [tuple(r) for r in queries.tokenize_documents(spark, path).collect()] == [(0, 7, 6)]


def test_split_modes_and_ids(engine):
    assert surfaces(engine, "東京都", "A") == ["東京", "都"] and surfaces(engine, "東京都") == ["東京都"] == surfaces(engine, "東京都", "B")
    m = engine.tokenize("京都")[0]
    assert (m["begin"], m["end"], m["pos"][:3], m["normalized_form"], m["dictionary_id"]) == (0, 2, ["名詞", "固有名詞", "地名"], "京都", 0)
    m = engine.tokenize("Ａxyz")[0]
    assert m["word_id"] == -1 and m["is_oov"] and (m["begin"], m["end"]) == (0, 4)
    with pytest.raises(ValueError):
        engine.tokenize("京都", "D")


def test_sentences_of_engine(engine):
    got = engine.split_sentences("京都に行く。\n東京に行く。")
    assert [(a, b) for a, b, _ in got] == [(0, 6), (7, 13)]
    quoted = "「本を買う。」と言う。京都に行く。"
    assert [quoted[a:b] for a, b, _ in engine.split_sentences(quoted)] == ["「本を買う。」と言う。", "京都に行く。"]


def test_tables(spark, engine):
    df = spark.createDataFrame([(1, "京都に行く"), (2, None), (3, "")], "id int, text string")
    out = {r["id"]: r for r in engine.tokenize_table(df).collect()}
    assert len(out[1]["morphemes"]) == 3 and out[2]["morphemes"] == [] == out[3]["morphemes"]
    flat = morphemes(engine.tokenize_table(df))
    assert [r["surface"] for r in flat.orderBy("pos_no").collect()] == ["京都", "に", "行く"]
    text = engine.tokenize_table(df).filter("id = 1").select(formats.wakati(F.col("morphemes")), formats.detailed(F.col("morphemes"))).first()
    assert text[0] == "京都 に 行く\n" and text[1].endswith("\t行く\nEOS\n") and text[1].startswith("京都\t名詞,固有名詞,地名,一般,*,*\t京都\n")
    broken = Engine(compiled([("あ", 1, "名詞")]))
    rows = broken.tokenize_table(df, tolerant=True).collect()
    assert [bool(r["error"]) for r in rows] == [True, False, False]


def test_dictionary_round_trip_and_user_dictionary(spark, tmp_path):
    user = [("府", 1, 1, 2914, "府", "名詞", "普通名詞", "一般", "*", "*", "*", "フ", "府", "*", "A", "*", "*", "*", "*", 0), ("東京府", 1, 1, -2000, "東京府", "固有", "*", "*", "*", "*", "*", "トウキョウフ", "東京府", "*", "B", "0/U0", "*", "0/U0", "1/3", 1)]
    rows = src.parse_rows(spark.createDataFrame(user, src.CSV_SCHEMA + ", seq long"))
    d = Dictionary.build([queries.parsed(spark), rows], queries.connection(spark))
    d.save(f"{tmp_path}/d")
    e = Engine(Dictionary.load(spark, f"{tmp_path}/d").compile(), oov=config.default_oov())
    ms = e.tokenize("東京府に行く")
    assert ms[0]["dictionary_id"] == 1 and ms[0]["pos"][0] == "固有" and ms[0]["synonym_group_ids"] == [1, 3]
    assert surfaces(e, "東京府に行く", "A") == ["東京", "府", "に", "行く"]
    lines = [r["line"] for r in d.printed().filter("dict_id = 0").orderBy("word_id").collect()]
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    again = src.parse_rows(src.read_csv(spark, f"{tmp_path}/p.csv"))
    cols = ["word_id", "headword", "left_id", "cost", "surface", "pos", "normalized"]
    assert sorted(map(str, again.select(*cols).collect())) == sorted(map(str, queries.parsed(spark).select(*cols).collect()))
    assert e.dictionary.word_of("京都", ms[0]["pos_id"], "x") is None
    assert ms[0]["original"] == "東京府"


def test_user_dictionary_printed_and_built_again(spark, tmp_path):
    """References of all kinds survive: own words, system words, inline."""
    system, user = queries.parsed(spark), rule_queries.user_rows(spark)
    d = Dictionary.build([system, user], queries.connection(spark))
    (tmp_path / "u.csv").write_text("\n".join(r["line"] for r in d.printed().filter("dict_id = 1").orderBy("word_id").collect()) + "\n", encoding="utf-8")
    again = Dictionary.build([system, src.parse_rows(src.read_csv(spark, f"{tmp_path}/u.csv"))], queries.connection(spark))
    cols = ["dict_id", "word_id", "headword", "dict_form", "form_dict", "form_word", "a_split", "b_split", "word_structure", "pos_id"]
    rows = lambda x: sorted(map(str, x.lexicon.select(*cols).collect()))
    assert rows(d) == rows(again)
    bad = user.withColumn("dict_form_ref", F.lit("U9"))
    with pytest.raises(Exception, match="unresolved reference U9"):
        Dictionary.build([system, bad], queries.connection(spark)).lexicon.collect()


@pytest.mark.parametrize("lines", [["-1 0 5"], ["2 2", "-1 0 5"], ["2 2", "3 3", "0 0 1"], ["0 0 5", "2 2"], ["2 2", "0 2 1"], ["2 2", "0 0"], ["2 2", "0 0 40000"], ["2 2", "0 0 1 1"], []])
def test_matrix_errors(spark, lines):
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines)], "value string, seq long")
    with pytest.raises(Exception, match="matrix"):
        src.parse_matrix(df).collect()


def test_matrix_and_edits(spark, tmp_path):
    (tmp_path / "m.def").write_text("\n  2 2\n\n0 1  -5\n1 0 7\n")
    m = src.read_matrix(spark, f"{tmp_path}/m.def")
    assert sorted(map(tuple, m.collect())) == [(0, 1, -5), (1, 0, 7)]
    assert src.parse_matrix(spark.createDataFrame([("3 3", 0)], "value string, seq long")).count() == 0
    edits = spark.createDataFrame([(0, 1, 1, 0), (0, 1, 3, 2), (0, 1, 2, 1)], "left int, right int, cost int, seq int").repartition(3)
    assert dict(((r[0], r[1]), r[2]) for r in edit_connections(m, edits).collect()) == {(0, 1): 3, (1, 0): 7}
    d = compiled([("あ", 1, "名詞")])
    for cell in ((-1, 0), (0, -1), (1, 0), (0, 1)):
        with pytest.raises(IndexError):
            d.connect(*cell)
    outside = queries.parsed(spark).withColumn("left_id", F.when(F.col("word_id") == 3, 99).otherwise(F.col("left_id")))
    with pytest.raises(ValueError, match="outside of the matrix"):
        Dictionary.build([outside], queries.connection(spark)).compile()


def test_word_ids(spark):
    df = spark.createDataFrame([(15, (1 << 28) - 1)], "d int, w int")
    assert df.select(encoded("d", "w")).first()[0] == -1
    for bad in (encoded(F.lit(16), F.lit(0)), encoded(F.lit(0), F.lit(1 << 28)), length_mask(F.lit(0)), length_mask(F.lit(65))):
        with pytest.raises(Exception, match="out of range"):
            df.select(bad).collect()
    assert df.select(length_mask(F.lit(35))).first()[0] == 1 << 34


def test_lexicon_errors(spark):
    def row(**kw):
        base = dict(zip(src.CSV_COLUMNS, ("a", 0, 0, 1, "a", *"pqrstu", "r", "n", "*", "A", "*", "*", "*", "*"))) | kw
        return src.parse_rows(spark.createDataFrame([(*base.values(), 0)], src.CSV_SCHEMA + ", seq long"))

    assert row(left_id=-1).first()["headword"] is None
    assert row(headword="a\\u002cb").first()["headword"] == "a,b"
    for bad in ({"headword": ""}, {"a_split_ref": "1/2"}, {"structure_ref": None}, {"synonym_ref": "/".join(["1"] * 128)}):
        with pytest.raises(Exception, match="line 1"):
            row(**bad).collect()


def test_compounds(spark):
    base = [("最後", 0, 0, 5000, "最後", "名詞", *"*****", "サイゴ", "最後", "*", "A", "*", "*", "*", "*", 0), ("だ", 0, 0, 5000, "だ", "助動詞", *"*****", "ダ", "だ", "*", "A", "*", "*", "*", "*", 1), ("から", 0, 0, 5000, "から", "助詞", *"*****", "カラ", "から", "*", "A", "*", "*", "*", "*", 2)]
    rows, conn = src.parse_rows(spark.createDataFrame(base, src.CSV_SCHEMA + ", seq long")), spark.createDataFrame([(0, 0, 0)], "left int, right int, cost int")
    for parts, want in (([rows], ["最後", "だ", "から"]), ([rows, src.compound_particles(spark)], ["最後", "だから"])):
        assert surfaces(Engine(Dictionary.build(parts, conn).compile(), oov=config.default_oov()), "最後だから") == want


def test_pos_matcher(spark):
    table = spark.createDataFrame([(0, ["名詞", "数詞"] + ["*"] * 4), (1, ["名詞", "一般"] + ["*"] * 4), (2, ["動詞"] + ["*"] * 5)], "pos_id int, pos array<string>")
    ids = lambda m: sorted(r[0] for r in m.ids.collect())
    noun, num = PosMatcher.from_list(table, iter([["名詞"]])), PosMatcher.from_list(table, [[None, "数詞"]])
    assert (ids(noun), ids(num), ids(noun.intersection(num)), ids(noun.union(num)), ids(noun.invert())) == ([0, 1], [0], [0], [0, 1], [2])
    with pytest.raises(ValueError):
        PosMatcher.from_list(table, [[]])


def test_config_and_plugins(spark):
    c = Config.parse('{"userDicts": ["a"], "oovProviderPlugin": [{"class": "x.SimpleOov", "pos": ["名詞","普通名詞","一般","*","*","*"], "register": true}], "editConnectionCostPlugin": [{"inhibitPair": [[1, 2]]}], "inputTextPlugin": []}')
    assert c.items("userDict") == ["a"] and Config({"a": 1}).with_fallback(Config({"a": 2, "b": 3})).values == {"a": 1, "b": 3}
    with pytest.raises(TypeError):
        c.string("userDict")
    e = config.engine(queries.demo_dictionary(spark), c)
    assert e.dictionary.connect(1, 2) == 32767 and type(e.oov[0]) is SimpleOov and len(e.input) == 1
    assert type(config.plugin("hinoki.functions.normalize:StripRuby")) is normalize.StripRuby
    with pytest.raises(ValueError):
        config.plugin("nothing")


class Twice(ConnectionEdit):
    def __init__(self, factor=2):
        self.factor = factor

    def edit(self, connection, lexicon):
        return connection.withColumn("cost", F.col("cost") * self.factor)


def test_default_profile_and_own_plugins(spark):
    d = queries.demo_dictionary(spark)
    with pytest.warns(UserWarning, match="larger connection matrix"):
        e = config.engine(d)
    assert [type(p).__name__ for p in e.oov] == ["CounterOov", "SimpleOov"] and e.input[0].replacements["ｶﾞ"] == "ガ"
    big = Dictionary(d.lexicon, d.pos, d.connection.union(spark.createDataFrame([(5999, 5999, 0)], "left int, right int, cost int")))
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        assert [type(p).__name__ for p in config.engine(big).oov] == ["CounterOov", "CategoryOov", "SimpleOov"]
        assert len(config.engine(d, unknown_rules=[]).oov) == 2
    assert surfaces(config.engine(big), "xyzペンギン本") == ["xyz", "ペンギン", "本"]
    with pytest.raises(ValueError, match="outside of the matrix"):
        config.engine(d, unknown_rules=definitions.UNKNOWN_WORDS)
    with pytest.raises(ValueError, match="line 1"):
        src.parse_unknown_rules(["NOTHING,0,0,1,名詞,*,*,*,*,*"])
    edit = Config.parse(json.dumps({"editConnectionCostPlugin": [{"class": "tests.test_analyzer:Twice", "factor": 3}]}))
    assert config.engine(d, edit, unknown_rules=[]).dictionary.connect(0, 5) == 3 * queries.demo_engine(spark).dictionary.connect(0, 5)
    with pytest.raises(TypeError, match="no OovProvider"):
        config.engine(d, Config({"oovProviderPlugin": [{"class": "JoinNumeric"}]}))
    with pytest.raises(TypeError):
        OovProvider()


def test_counters():
    assert counters.resolve("かい").surface == "回" and counters.resolve("かい", "階").surface == "階"
    assert counters.resolve("x", "y", "本").surface == "本" and counters.resolve("x") is None
    assert [c.surface for c in counters.with_surface("さい")] == ["歳", "才"]
    assert counters.resolve("本").after("サン") == "サンボン" and counters.resolve("円").after("サン") == "サンエン"
    assert counters.DAYS["ニジュウ"] == "ハツカ" and "以上" in counters.SUFFIXES


def test_fields_and_offsets(spark, engine):
    df = spark.createDataFrame([("😀京都に行く",)], "text string")
    first = engine.tokenize_table(df, fields=["surface", "begin", "original"]).first()["morphemes"]
    assert [tuple(m) for m in first][:2] == [("😀", 0, "😀"), ("京都", 1, "京都")]
    ends = lambda unit: [m["end"] for m in engine.tokenize_table(df, fields=["end"], offsets=unit).first()["morphemes"]]
    assert (ends("code points"), ends("utf-16"), ends("bytes")) == ([1, 3, 4, 6], [2, 4, 5, 7], [4, 10, 13, 19])
    with pytest.raises(ValueError):
        engine.tokenize_table(df, fields=["nothing"])
    with pytest.raises(ValueError):
        engine.tokenize_table(df, offsets="inches")
    whole = engine.tokenize("ＡＢＣと京都")
    assert list(whole[0]) == list(FIELDS) and (whole[0]["surface"], whole[0]["original"]) == ("abc", "ＡＢＣ")


def test_cost_grows_with_the_text(engine):
    """Eight times the text takes well under sixty-four times as long."""
    for make in (lambda n: "x" * n, lambda n: "京都に行く" * (n // 5), lambda n: "1" * n, lambda n: "À㍿" * (n // 2), lambda n: "1,234,567." * (n // 10)):
        took = []
        for n in (4000, 32000):
            best = []
            for _ in range(3):
                began = time.perf_counter()
                engine.tokenize(make(n))
                best.append(time.perf_counter() - began)
            took.append(min(best))
        assert took[1] < 24 * max(took[0], 0.002), make(10)


def test_long_words_veto_boundaries():
    long = "あ" * 50 + "。" + "い" * 5
    e = Engine(compiled([(long, 1, "名詞"), ("う", 1, "名詞")]), oov=[SimpleOov(NOUN, register=True)])
    assert [e for _, e, _ in e.split_sentences("う。" + long + "う。")] == [2, 2 + len(long) + 2]


def test_stream_equals_batch(spark, engine, tmp_path):
    text = "京都に行く。「本を買う。」と言う。\n東京都に行く。ねことねる"
    want = [text[a:b] for a, b, _ in engine.split_sentences(text)]
    rng = random.Random(1)
    for _ in range(20):
        tail, got, cuts = "", [], sorted(rng.sample(range(1, len(text)), 4))
        for a, b in zip([0, *cuts], [*cuts, len(text)]):
            out, tail = complete(engine, tail + text[a:b], b == len(text), 4096)
            got += out
        assert [g.strip() for g in got] == want
    chunks = [("k", i, text[a:b], b == len(text)) for i, (a, b) in enumerate([(0, 9), (9, 20), (20, len(text))])]
    schema = "key string, seq long, chunk string, last boolean"
    for i in (2, 0, 1):  # out of order
        spark.createDataFrame([chunks[i]], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = sentence_stream(stream, engine).writeStream.format("memory").queryName("sents").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.sql("select * from sents").orderBy("sent_no").collect()
    assert [r["sentence"].strip() for r in rows] == want and rows[0]["surfaces"] == "京都 に 行く 。"
    shutil.rmtree(f"{tmp_path}/in")


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    order = [want.columns.index(c) for c in cols]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in got.collect()))) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())


def test_keys_of_a_stream_share_groups(spark, engine, tmp_path):
    """In two buckets every key keeps its own state, the null key too, and all states go."""
    keys = [None, "null", *map(str, range(9))]
    for n, rows in enumerate(([(k, 1, "行く。", True) for k in keys[:-1]], [(k, 0, "京都に行く。東京に", False) for k in keys])):
        time.sleep(0.01)
        spark.createDataFrame(rows, "key string, seq long, chunk string, last boolean").coalesce(1).write.parquet(f"{tmp_path}/in/a={n}")
    stream = spark.readStream.schema("key string, seq long, chunk string, last boolean, a int").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("a")
    q = sentence_stream(stream, engine, buckets=2).writeStream.format("memory").queryName("shared_groups").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("shared_groups").collect()), key=str)
    first, second = (0, "京都に行く。", "京都 に 行く 。"), (1, "東京に行く。", "東京 に 行く 。")
    want = [(k, *s) for k in keys for s in ((first, second) if k != "8" else (first,))]
    assert got == sorted(want, key=str)
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 2 and q.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1


def test_triggers_of_stream_sentences_dont_grow_with_files(spark, tmp_path):
    spark.range(40).select(F.col("id").alias("doc_id")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "128m")
    done = queries.QUERIES["stream_sentences"](spark, str(tmp_path))
    spark.conf.unset("spark.sql.files.openCostInBytes")
    root = done.inputFiles()[0].rsplit("/out/", 1)[0].removeprefix("file://")
    assert len([x for x in os.listdir(f"{root}/state/commits") if not x.startswith(".")]) == 2
    assert done.count() == 40
