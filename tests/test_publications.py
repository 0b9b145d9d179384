"""Publications: one content once, one revision for one writer, and failures after which the revision tells whose it is."""

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from ratingloom.sources.publications import Publications, RevisionTaken


@pytest.fixture
def rows(spark):
    return spark.range(50).select(F.col("id").alias("a.b"), F.lit("x").alias("t"))


def test_one_content_once(spark, rows, tmp_path):
    p = Publications(spark, f"file://{tmp_path}")
    assert p.read("s", "2026-07") is None and p.history().count() == 0
    first, new = p.publish(rows, "s/ ?#", "2026-07")
    again, old = p.publish(rows.orderBy(F.desc("`a.b`")).repartition(3), "s/ ?#", "2026-07")
    assert (new, old) == (True, False) and again == first and first.number == 1
    second, _ = p.publish(rows.limit(10), "s/ ?#", "2026-07")
    assert second.number == 2 and p.read("s/ ?#", "2026-07").count() == 10 and p.read("s/ ?#", "2026-07", 1).count() == 50
    assert p.publish(rows, "s/ ?#", "2026-07")[0].number == 3, "an earlier content is a new revision"
    assert p.publish(rows, "s/ ?#", "2026-08")[0].number == 1 and p.history().count() == 4


def test_two_writers(spark, rows, tmp_path):
    one, two = Publications(spark, f"file://{tmp_path}", "one"), Publications(spark, f"file://{tmp_path}", "two")
    one.publish(rows, "s", "m", onto=0)
    with pytest.raises(RevisionTaken):
        two.publish(rows.limit(3), "s", "m", onto=0)
    assert two.publish(rows, "s", "m", onto=0)[1] is False, "the same content is there already"
    made, new = two.publish(rows.limit(3), "s", "m", onto=1)
    assert new and made.number == 2 and one.read("s", "m").count() == 3
    # Nothing is left of what was not published.
    fs, folder = one.at(f"{one.path}/reports/s/m")
    assert len(fs.listStatus(folder)) == 2


def test_race_for_a_revision(spark, rows, tmp_path, monkeypatch):
    """Another writer commits between this one's look and its rename."""
    one, two = Publications(spark, f"file://{tmp_path}", "one"), Publications(spark, f"file://{tmp_path}", "two")
    rename = Publications.rename_once

    def late(self, source, target):
        monkeypatch.setattr(Publications, "rename_once", rename)
        two.publish(rows.limit(7), "s", "m")
        rename(self, source, target)

    monkeypatch.setattr(Publications, "rename_once", late)
    with pytest.raises(RevisionTaken):
        one.publish(rows, "s", "m")
    assert one.numbers("s", "m") == [1] and one.revision("s", "m").writer.startswith("two:")


def test_lost_answer(spark, rows, tmp_path, monkeypatch):
    """The rename happens and its answer is an error: the revision is found to be this writer's."""
    one = Publications(spark, f"file://{tmp_path}", "one")
    rename = Publications.rename_once

    def lost(self, source, target):
        rename(self, source, target)
        self.at(f"{self.path}/none")[0].open(self.at(f"{self.path}/none")[1])

    monkeypatch.setattr(Publications, "rename_once", lost)
    made, new = one.publish(rows, "s", "m")
    assert new and made.number == 1 and one.numbers("s", "m") == [1]

    def broken(self, source, target):
        self.at(f"{self.path}/none")[0].open(self.at(f"{self.path}/none")[1])

    monkeypatch.setattr(Publications, "rename_once", broken)
    with pytest.raises(Py4JJavaError):
        one.publish(rows.limit(5), "s", "m")
    assert one.numbers("s", "m") == [1] and one.read("s", "m").count() == 50
