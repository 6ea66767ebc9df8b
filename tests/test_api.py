import pytest

from kinelake.api import Session


@pytest.fixture()
def session(spark):
    rows = [(1, "a", 0.0, 5.0, 0.9, "walk+turn", None), (2, "b", 3.0, 4.0, None, "sit", 10.0), (3, "a", 1.0, 9.0, 0.5, "walk", 5.0), (4, "c", 2.0, 3.0, 0.9, None, 1.0)]
    return Session(spark.createDataFrame(rows, 'id long, source string, start double, end double, score double, class string, yaw double'))


def ids(page):
    return [r["id"] for r in page["rows"]]


def test_pages_and_orders(session):
    assert ids(session.list_results()) == [1, 4, 3, 2] and ids(session.list_results(order="yaw")) == [4, 3, 2, 1] and ids(session.list_results(order="shortest")) == [2, 4, 1, 3]
    p = session.list_results(offset=1, limit=2)
    assert ids(p) == [4, 3] and p["total"] == 4 and p["next"] == 3 and session.list_results(offset=2, limit=2)["next"] is None
    assert ids(session.list_results(facet="walk")) == [1, 3] and ids(session.list_results(source="a", least=0.6)) == [1]
    for bad in ({"limit": 0}, {"limit": 201}, {"offset": -1}, {"order": "x"}, {"limit": True}):
        with pytest.raises(ValueError):
            session.list_results(**bad)


def test_edits_and_undo(session):
    assert session.list_classes() == {"walk+turn": 1, "walk": 2, "turn": 1, "sit": 1}
    session.set_classification(2, "walk")
    session.set_review(1, "favorite")
    session.set_clip_range(3, 2.0, 2.5)
    assert session.list_classes()["walk"] == 3 and ids(session.list_results(review="favorite")) == [1] and ids(session.list_results(order="shortest"))[0] == 3
    assert session.undo() and ids(session.list_results(order="longest"))[0] == 3
    session.set_clip_range(3, 2.0, 2.5)
    session.reset_clip_range(3)
    assert ids(session.list_results(order="longest"))[0] == 3 and session.status()["edits"] == 4
    assert session.undo() and ids(session.list_results(order="shortest"))[0] == 3  # a reset is an edit too
    with pytest.raises(ValueError):
        session.set_review(1, "loved")
    with pytest.raises(ValueError):
        session.set_clip_range(1, 3.0, 2.0)


def test_export(session, spark, tmp_path):
    session.set_review(3, "hidden")
    session.export(str(tmp_path / "out"), "csv", by_class=["sit"])
    got = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert sorted(r.id for r in got.collect()) == ["1", "2", "4"]


def test_only_the_last_edits_can_be_undone(session):
    for i in range(20):
        session.set_classification(1, f"c{i}")
    assert [session.undo() for _ in range(17)] == [True] * 16 + [False] and session.list_classes()["c3"] == 1


def test_functions_in_sql_and_tags(session, spark):
    from kinelake.functions.registered import register

    assert register(spark) == ["kl_cosine", "kl_timecode", "kl_upper_median"]
    r = spark.sql("SELECT kl_cosine(array(1D, 0D), array(1D, 1D)) AS c, kl_cosine(array(0D), array(1D)) AS z, kl_timecode(90000.5D, 24D) AS t").first()
    assert abs(r.c - 0.5**0.5) < 1e-12 and r.z is None and r.t == "25:00:00:12"
    assert spark.sql("SELECT kl_upper_median(x) AS m FROM VALUES (1D), (4D), (2D), (3D) AS t(x)").first().m == 3.0
    assert session.run("one", lambda s: s.rows.count()) == 4 and session.interrupt("none") == []
