"""Steps of the health score that several queries start from.

Each is computed once per session and table folder when first asked for, and
written to the shared folder, as a production run would do; ``forget`` starts
afresh.
"""

from __future__ import annotations

from functools import cached_property

from queries import inputs as i
from rotorwatch.operators.baseline import baseline_slice, detect_baseline
from rotorwatch.operators.fleet import device_records, device_summary
from rotorwatch.operators.model import predict_scores, score_rows, train_model
from rotorwatch.plans.health_scoring import clean_rows
from rotorwatch.session import materialize

_DONE: dict = {}


class Stages:
    def __init__(self, spark, sf):
        self.spark, self.sf = spark, sf
        self.devices = i.device_dim(spark, sf)

    @cached_property
    def rows(self):
        tele, tags = i.telemetry(self.spark, self.sf), i.tag_dim(self.spark, self.sf)
        vib = i.vib(self.spark, self.sf)
        return materialize(clean_rows(vib, tele, self.devices, tele, tags, i.TOLERANCE_S), "clean")

    @cached_property
    def candidates(self):
        return materialize(detect_baseline(self.rows), "candidates")

    @cached_property
    def baseline(self):
        return materialize(baseline_slice(self.rows, self.candidates, self.devices), "baseline")

    @cached_property
    def model(self):
        return materialize(train_model(self.baseline), "model")

    @property
    def predicted(self):
        return predict_scores(self.rows, self.model)

    @cached_property
    def scored(self):
        return materialize(self.predicted, "scored")

    @property
    def summary(self):
        return device_summary(device_records(score_rows(self.rows, self.model), self.baseline, self.devices))


def scoring(spark, sf) -> Stages:
    key = (spark.conf.get("spark.app.id", ""), sf)
    if key not in _DONE:
        _DONE[key] = Stages(spark, sf)
    return _DONE[key]


def forget() -> None:
    _DONE.clear()
