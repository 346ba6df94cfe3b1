from quillgraph.sources import readers, sinks


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_readers(spark, tmp_path):
    (tmp_path / "t").write_text("1 a  b a\n2 c\nx y\n\n3\n")
    assert rows(readers.terms(spark, str(tmp_path / "t"))) == [(1, "a b a"), (2, "c"), (3, "")]
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "7.x.txt").write_text("one\ntwo")
    (tmp_path / "s" / "8.md").write_text("no")
    assert rows(readers.speeches(spark, str(tmp_path / "s"))) == [("7.x", "one\ntwo")]
    (tmp_path / "e").write_text("m1 a b\nm2 b c d\nbad\n")
    assert rows(readers.edge_list(spark, str(tmp_path / "e")).select("msg_id", "src", "dst")) == [("m1", "a", "b"), ("m2", "b", "c")]
    (tmp_path / "a").write_text("ann : a@x,b@x,\r\nbob : b@x,\r\n")
    known = readers.aliases(spark, str(tmp_path / "a"))
    assert rows(known) == [("a@x", "ann"), ("b@x", "bob")]
    (tmp_path / "r").write_text("a\tAnn Lee  y  Manager\nq\t\n")
    assert rows(readers.roles(spark, str(tmp_path / "r"), "x", {"q": "b@x"}, known).na.fill("-")) == [("a@x", "ann", "Ann Lee  y  Manager"), ("b@x", "bob", "-")]
    (tmp_path / "m").write_text("<DOC> a/b/id1\nFrom: x\nSubject: Hi there\nSubject: no\n\nbody one\nSubject: in body\n</DOC>\n<DOC> id2\nFrom: y\n\ntext\n</DOC>\n")
    got = {r.msg_id: (r.subject, r.body.strip()) for r in readers.mail_archive(spark, str(tmp_path / "m")).collect()}
    assert got == {"id1": ("Hi there", "body one\nSubject: in body"), "id2": (None, "text")}
    (tmp_path / "v").write_text("The cat, the Dog's\ncat")
    assert rows(readers.vocabulary(spark, str(tmp_path / "v"))) == [("cat",), ("dogs",)]


def test_fetch_survives_failures(spark):
    def get(url):
        if url == "b":
            raise OSError
        return 200, "page " + url

    got = readers.fetch(spark.createDataFrame([("a",), ("b",)], "url string"), get)
    assert {tuple(r) for r in got.collect()} == {("a", 200, "page a"), ("b", 0, None)}


def test_sinks(spark, tmp_path):
    def text(name):
        return [r.value for r in spark.read.text(str(tmp_path / name)).collect()]

    scores = spark.createDataFrame([("a", 0.25), ("b", 0.5)], "node string, score double")
    assert sinks.score_file(scores, str(tmp_path / "s"), known=("a", 0.2, 0.3))
    assert text("s") == ["0.50000000 b", "0.25000000 a"]
    assert not sinks.score_file(scores, str(tmp_path / "n"), known=("a", 0.3, 0.4))
    sinks.pair_file(spark.createDataFrame([(2, 3), (1, 9)], "id_a int, id_b int"), str(tmp_path / "p"))
    assert sorted(text("p")) == ["1-9", "2-3"]
    sinks.run_file(spark.createDataFrame([(1, 2, 0.5)], "query_id int, doc_id int, score double"), str(tmp_path / "r"))
    assert text("r") == ["1 0 2 0 0.5 0"]
    sinks.dot_file(spark.createDataFrame([("a", "b", "w")], "src string, dst string, label string"), str(tmp_path / "d"))
    assert text("d") == ["digraph G {", '"a" -> "b" [label = "w"];', "}"]
    sinks.grid_file(spark.createDataFrame([(0, 0.5, 15, 20, 0.1)], "run int, k double, n_d int, n_w int, map double"), str(tmp_path / "g"))
    assert text("g") == ["run,k,n_d,n_w,map", "0,0.5,15,20,0.1"]
