from quillgraph.__main__ import main


def text(spark, path):
    return sorted(r.value for r in spark.read.text(str(path)).collect())


def test_runs(spark, tmp_path):
    (tmp_path / "d").write_text("1 red fox red\n2 fox den\n3 blue sky blue sky\n")
    (tmp_path / "q").write_text("10 red fox fox\n")
    (tmp_path / "r").write_text("10 0 1 1\n10 0 3 0\n")
    q, d, out = str(tmp_path / "q"), str(tmp_path / "d"), str(tmp_path / "out")
    main(["overlap", q, d, out], spark)
    assert text(spark, out) == ["10 0 1 0 2 0", "10 0 2 0 1 0"]
    main(["tfidf", q, d, out], spark)
    assert [x[:15] for x in text(spark, out)] == ["10 0 1 0 0.8196", "10 0 2 0 0.3475"]
    main(["feedback", q, d, out, "-d", "1"], spark)
    assert len(text(spark, out)) == 2


def test_duplicates(spark, tmp_path):
    body = "banner\n\n" + "a line of text that is longer than seven words\n" * 3
    for name, t in (("1", body), ("2", body), ("3", body + "it cost 5 6 and 7 8 units here\n")):
        (tmp_path / f"{name}.txt").write_text(t)
    for flags in ([], ["-e"], ["--no-zlib", "-b", "64", "-s", "2"]):
        main(["duplicates", str(tmp_path), str(tmp_path / "out"), *flags], spark)
        assert text(spark, tmp_path / "out" / "exact") == ["1-2"]
        assert "1-2" in text(spark, tmp_path / "out" / "near")
        assert text(spark, tmp_path / "out" / "plateau") == []


def test_links_and_network(spark, tmp_path):
    pairs = [(a, b) for a in "abc" for b in "abc" if a != b]
    (tmp_path / "e").write_text("".join(f"m{a}{i} {a}@x {b}@x\n" for a, b in pairs for i in range(5)))
    (tmp_path / "al").write_text("ann : a@x,\nbob : b@x,\ncat : c@x,\n")
    (tmp_path / "ro").write_text("a\tAnn Lee  y  Manager  Gas\n")
    (tmp_path / "ma").write_text("".join(f"<DOC> x/m{a}{i}\nSubject: gas {a} deal\n\nb\n</DOC>\n" for a in "abc" for i in range(5)))
    (tmp_path / "vo").write_text("Gas, power.")
    p = {k: str(tmp_path / k) for k in ("e", "al", "ro", "ma", "vo", "out", "net")}
    main(["links", p["e"], p["out"]], spark)
    assert text(spark, tmp_path / "out" / "pagerank") == [f"0.33333333 {x}@x" for x in "abc"]
    main(["network", p["e"], p["al"], p["ro"], p["ma"], p["vo"], p["net"]], spark)
    lines = text(spark, p["net"])
    assert len(lines) == 8 and all('[label = "gas"];' in x for x in lines if "->" in x)


def test_crawl(spark, tmp_path):
    page = '<!-- CONTENT --><a href="{}">x</a><!-- /CONTENT -->'
    rows = [("http://h/a", page.format("b")), ("http://h/b", page.format("c")), ("http://h/c", page.format("http://o/d")), ("http://o/d", "")]
    spark.createDataFrame(rows, "url string, html string").write.parquet(str(tmp_path / "p"))
    spark.createDataFrame([("h", 200, "User-agent: *\nDisallow: /c")], "domain string, status int, body string").write.parquet(str(tmp_path / "r"))
    args = ["crawl", str(tmp_path / "p"), str(tmp_path / "o"), "--seed", "http://h/a", "--domain", "h"]
    main(args, spark)
    assert sorted(r.page_id[-1] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b", "c"]
    main([*args, "--robots", str(tmp_path / "r")], spark)
    assert sorted(r.page_id[-1] for r in spark.read.parquet(str(tmp_path / "o")).collect()) == ["a", "b"]
