"""The chain on fitted models, bundles and files."""

import threading

import pytest

from martlight.plans import chain as c
from martlight.plans import recommender as rec
from martlight.plans import segments as s
from martlight.plans import value as v
from martlight.plans.features import features_table


@pytest.fixture(scope="module")
def chain(star):
    return c.run_chain(star, {"k_range": range(2, 4), "restarts": 1}, {"trees": 4})


def test_every_step_rests_on_the_fits(chain):
    tables = chain.tables
    persons = tables["features"].count()
    assert tables["segments"].count() == tables["retention"].count() == persons
    assert tables["retention"].where("segment is null").count() == 0
    scored = {r[0]: r[1] for r in tables["predictions"].select(c.PERSON, v.PREDICTED).collect()}
    for r in tables["retention"].select(c.PERSON, v.PREDICTED).collect():
        assert r[1] == pytest.approx(scored.get(r[0], 0.0))
    gap = tables["attributions"].selectExpr("max(abs(model_output - prediction))").head()[0]
    assert gap < 1e-8
    report = {(r["category"], r["metric"]) for r in chain.report.collect()}
    assert len(report) == 18 and {x for x, _ in report} == {"CLV", "Retention Opportunity", "Portfolio KPI"}


def test_bundles_give_the_same_results(spark, star, chain, tmp_path):
    features = features_table(star)
    labels = c.segment_labels(chain.segments, features)
    c.save_segments(chain.segments, labels, str(tmp_path / "segments"))
    loaded, again = c.load_segments(spark, str(tmp_path / "segments"))
    assert again == labels and loaded.silhouette == chain.segments.silhouette and loaded.k == chain.segments.k
    assert sorted(map(tuple, s.assign_clusters(loaded, features).select(c.PERSON, "cluster_id").collect())) == sorted(
        map(tuple, s.assign_clusters(chain.segments, features).select(c.PERSON, "cluster_id").collect())
    )
    c.save_value(chain.value, str(tmp_path / "value"), "2024-01-01", {"MAE": 1.0})
    value, meta = c.load_value(spark, str(tmp_path / "value"))
    assert meta["metrics"] == {"MAE": 1.0} and value.features == v.FEATURES
    data = v.modelling_set(star)
    assert sorted(r[0] for r in v.score(value, data).select(v.PREDICTED).collect()) == sorted(
        r[0] for r in v.score(chain.value, data).select(v.PREDICTED).collect()
    )
    c.save_recommender(chain.recommender, str(tmp_path / "recommender"))
    stored = c.load_recommender(spark, str(tmp_path / "recommender"))
    few = star.customers.select(c.PERSON).distinct().limit(20)
    assert sorted(map(tuple, rec.recommend(stored, 3, few).collect())) == sorted(map(tuple, rec.recommend(chain.recommender, 3, few).collect()))


def test_file_scoring_sets_rows_aside(spark, chain, tmp_path):
    header = ",".join(["customer_id", *v.FEATURES])
    rows = ["a,1,2,3,4,5,6,7,8", "b,x,2,3,4,5,6,7,8", "c,-1,2,3,4,5,6,7,8", "d,1,2,3,4,5,6,7,"]
    (tmp_path / "in.csv").write_text("\n".join([header, *rows]) + "\n")
    counts = c.score_files(spark, chain.value, str(tmp_path / "in.csv"), str(tmp_path / "out"))
    assert counts == {"input_rows": 4, "scored_rows": 1, "rejected_rows": 3}
    scored = spark.read.option("header", True).csv(str(tmp_path / "out" / "scored")).collect()
    assert [r["customer_id"] for r in scored] == ["a"] and float(scored[0][v.PREDICTED]) >= 0
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "rejected")).count() == 3


def test_fits_run_side_by_side(star, monkeypatch):
    meeting = threading.Barrier(3, timeout=20)

    class Met(Exception):
        pass

    def meet(*args, **options):
        meeting.wait()
        raise Met

    for owner, name in ((c, "fitted_segments"), (c, "fitted"), (c.rec, "purchase_rows")):
        monkeypatch.setattr(owner, name, meet)
    with pytest.raises(Met):
        c.run_chain(star)
