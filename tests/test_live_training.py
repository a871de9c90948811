from conftest import SMALL

from showcase import REGISTRY, ingestion


def test_the_live_forest_learns_from_a_table_not_from_windows(spark, monkeypatch):
    plans, fit = [], ingestion.fit_forest

    def seen(train, *args, **more):
        plans.append(train._jdf.queryExecution().optimizedPlan().toString())
        return fit(train, *args, **more)

    monkeypatch.setattr(ingestion, "fit_forest", seen)
    run, _ = REGISTRY["live_scoring"]
    assert run(spark, SMALL).filter("has_score").count() > 0
    # each pass of the fit would take the windows over the whole history again
    assert len(plans) == 1 and "Window" not in plans[0]
