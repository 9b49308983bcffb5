from quiremill.operators import convert as U
from quiremill.sources.tables import scan_files


def test_one_failure_never_stops_the_others(spark):
    def picky(name, content, target):
        if name.startswith("locked"):
            return U.Failure("password_wrong" if name.startswith("locked2") else "password_needed", name)
        if name.startswith("broken"):
            raise ValueError("bad bytes")
        if name.startswith("two"):
            return [("two-1.txt", b"1", None, None), ("two-2.txt", b"22", "a note", "a warning")]
        return U.text_handler(name, content, target)

    names = ["ok.docx", "locked.doc", "locked2.doc", "broken.odt", "two.rtf", "pic.png", "odd.zzz"]
    df = spark.createDataFrame([(i, n, b"text") for i, n in enumerate(names)], "file_id long, name string, content binary")
    got = sorted((r.file_id, r.result_no, r.name, r.status, r.error_kind, r.size) for r in U.convert_corpus(df, U.Registry().register("office", picky), "txt").collect())
    assert got == [(0, 0, "ok.txt", "ok", None, 4), (1, 0, "locked.doc", "error", "password_needed", None), (2, 0, "locked2.doc", "error", "password_wrong", None),
                   (3, 0, "broken.odt", "error", "unknown", None), (4, 0, "two-1.txt", "ok", None, 1), (4, 1, "two-2.txt", "ok", None, 2),
                   (5, 0, "pic.png", "error", "convert", None), (6, 0, "odd.zzz", "error", "convert", None)]


def test_missing_module_is_a_load_failure(spark):
    df = spark.createDataFrame([(1, "a.docx", b"x")], "file_id long, name string, content binary")
    r = U.convert_corpus(df, U.register_task(U.Registry(), "office", U.text_handler, ("no_such_module_here",)), "txt").first()
    assert (r.status, r.error_kind) == ("error", "load")


def test_merge_numbers_the_parts_of_a_batch(spark):
    df = spark.createDataFrame([(i, "b", 10 - i, f"f{i}.pdf", b"x") for i in range(4)], "file_id long, batch string, pos int, name string, content binary")
    got = U.convert_corpus(df, U.Registry().register("pdf", lambda n, c, t: [(n, bytes(c), None, None)]), "merge", merge=True)
    assert sorted((r.part_no, r.file_id) for r in got.collect()) == [(1, 3), (2, 2), (3, 1), (4, 0)]


def test_scan_reads_no_bytes_unless_asked(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    df = scan_files(spark, str(tmp_path))
    assert "content" not in df._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    r = scan_files(spark, str(tmp_path), with_content=True).first()
    assert (r["name"], r["size"], bytes(r["content"])) == ("a.bin", 5, b"12345")
