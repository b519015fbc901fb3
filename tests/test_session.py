"""The shared folder is named in full, so that other readers than Spark look in the same store."""

from polisgraph import session


def test_paths_have_their_store(spark):
    assert session.qualified(spark, "/a/b/") == "file:/a/b"
    assert session.qualified(spark, "file:///a/b") == "file:/a/b" or session.qualified(spark, "file:///a/b") == "file:///a/b"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.elsewhere.link./shared", "file:///tmp")
    conf.set("fs.defaultFS", "viewfs://elsewhere")
    try:
        assert session.qualified(spark, "/shared/x") == "viewfs://elsewhere/shared/x"
    finally:
        conf.set("fs.defaultFS", before)


def test_shared_dir_is_the_sessions(spark):
    assert session.shared_dir(spark).startswith("file:/")
    assert session.new_path(spark, "n").startswith(session.shared_dir(spark) + "/n-")
