"""Command-line tools against the engine they wrap."""

import json

import pytest
from hinoki.functions import formats
from hinoki.plans import queries, tools
from pyspark.sql import functions as F

HEAD = "{},{},{},{},{},{},{},{},*,A,*,*,*,*\n"


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("dict")
    lines = [r["line"] for r in queries.demo_dictionary(spark).printed().orderBy("word_id").collect()]
    (root / "lex.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
    cells = queries.connection(spark).collect()
    n = 1 + max(max(c["left"], c["right"]) for c in cells)
    (root / "matrix.def").write_text(f"{n} {n}\n" + "".join(f"{c['left']} {c['right']} {c['cost']}\n" for c in cells))
    (root / "user.csv").write_text(HEAD.format("すもも園", 1, 1, -5000, "すもも園", "名詞,固有名詞,地名,新,*,*", "スモモエン", "すもも園"), encoding="utf-8")
    (root / "text.txt").write_text("東京都に行く\n\n京都に行く", encoding="utf-8")
    tools.main(["build-system", "-o", f"{root}/sys", "-m", f"{root}/matrix.def", "-d", "a test", f"{root}/lex.csv"])
    tools.main(["build-user", "-o", f"{root}/user", "-s", f"{root}/sys", f"{root}/user.csv"])
    return root, lines


def test_build_and_print(spark, places, capsys):
    root, lines = places
    tools.main(["print-dict", f"{root}/sys"])
    assert capsys.readouterr().out.splitlines() == lines
    tools.main(["print-dict", "-s", f"{root}/sys", f"{root}/user"])
    assert capsys.readouterr().out.startswith("すもも園,1,1,-5000,")
    tools.main(["print-header", f"{root}/sys", f"{root}/user"])
    out = capsys.readouterr().out
    assert "type: system dictionary" in out and "type: user dictionary" in out and "description: a test" in out
    with pytest.raises(ValueError):
        tools.printed(spark, f"{root}/user")


def test_statistics(spark, places):
    root, lines = places
    told = []
    stats = tools.build(spark, f"{root}/again", [f"{root}/lex.csv"], matrix=f"{root}/matrix.def", progress=lambda *x: told.append(x))
    assert told[:2] == [("inputs", f"{root}/lex.csv", None), ("inputs", f"{root}/lex.csv", len(lines))] and told[-1] == ("outputs", "meta", 1)
    assert json.loads(tools.rendered(stats, "json"))["inputs"][0]["entries"] == len(lines)
    assert tools.rendered(stats, "csv").splitlines()[0] == "part,name,time_ms,entries"
    assert f"{root}/lex.csv" in tools.rendered(stats, "console")
    with pytest.raises(ValueError):
        tools.build(spark, f"{root}/none", [f"{root}/lex.csv"])


def test_analyze(spark, places, capsys):
    root, _ = places
    base = ["analyze", "--systemDict", f"{root}/sys", f"{root}/text.txt"]
    tools.main([*base, "-ts", "-m", "A"])
    assert capsys.readouterr().out == "東京 都 に 行く\n京都 に 行く\n"
    tools.main([*base, "-t"])
    assert capsys.readouterr().out == "東京都 に 行く 京都 に 行く "
    tools.main([*base, "-a"])
    want = queries.demo_engine(spark).tokenize_table(spark.createDataFrame([(x,) for x in ("東京都に行く", "京都に行く")], "text string"))
    want = "".join(r[0] for r in want.select(formats.detailed(F.col("morphemes"), True)).collect())
    assert capsys.readouterr().out == want
    tools.main([*base, "-d", "--format", "hinoki.functions.formats:wakati"])
    assert "東京都 に 行く" in capsys.readouterr().out
    tools.main([*base, "-ts", "-f", "-o", f"{root}/out"])
    assert [r[0] for r in spark.read.text(f"{root}/out").collect()] == ["東京都 に 行く", "京都 に 行く"]
    with pytest.raises(ValueError):
        tools.main(["analyze", f"{root}/text.txt"])


def test_settings_and_user_dictionary(spark, places, capsys):
    root, _ = places
    (root / "text2.txt").write_text("すもも園に行く\n", encoding="utf-8")
    (root / "conf.json").write_text(json.dumps({"systemDict": "sys", "enableDefaultCompoundParticles": False}))
    tools.main(["analyze", "-r", f"{root}/conf.json", "-p", str(root), "--userDict", "user", "-ts", f"{root}/text2.txt"])
    assert capsys.readouterr().out == "すもも園 に 行く\n"
    tools.main(["analyze", "-r", f"{root}/conf.json", "-s", '{"userDict": ["user"]}', "-p", str(root), "-ts", f"{root}/text2.txt"])
    assert capsys.readouterr().out == "すもも園 に 行く\n"
