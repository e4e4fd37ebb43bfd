"""Registered queries without SQL run over whole tables."""

from kinolake.plans import all_queries
from kinolake.plans.choice_queries import store
from kinolake.sources.fixtures import Relations

DATA = "/root/testdata/sf0.001"


def test_the_model_judges_every_window(spark):
    keys = ["vid", "start_time", "end_time"]
    got = all_queries()["ml03_trained_model"](spark, DATA)
    assert Relations(spark, DATA).feat.select(*keys).exceptAll(got.where("label = 'click'").select(*keys)).isEmpty()


def test_explorers_see_all_annotations_and_predictions(spark):
    t = Relations(spark, DATA)
    assert store(t).annotations.count() == t.ann.count() and store(t).predictions.count() == t.pred.count()
