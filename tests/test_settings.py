from __future__ import annotations

import pytest

from polka.settings import load_settings


def test_environment_goes_before_secrets():
    s = load_settings("gemini-x", {"MATCH_THRESHOLD": 60, "VISION_WORKERS": "3", "GEMINI_API_KEY": " k "}, {"MATCH_THRESHOLD": "80.5"})
    assert (s.match_threshold, s.vision_workers, s.min_recognition_confidence, s.model, s.key) == (80.5, 3, 0.55, "gemini-x", "k")
    assert "k " not in repr(s) and "key" not in repr(s)
    assert load_settings("gemini-x", {"MATCH_THRESHOLD": 60}, {"MATCH_THRESHOLD": " "}).match_threshold == 72.0
    assert load_settings("gemini-x", {}, {"GEMINI_MODEL": " gemini-2.y-z "}).model == "gemini-2.y-z"


@pytest.mark.parametrize("env", [{"MATCH_THRESHOLD": "49.9"}, {"MATCH_THRESHOLD": "nan"}, {"MATCH_THRESHOLD": "x"}, {"VISION_WORKERS": "5"}, {"VISION_WORKERS": "1.5"}, {"MIN_RECOGNITION_CONFIDENCE": "1.1"}, {"GEMINI_MODEL": "other"}, {"GEMINI_MODEL": ""}, {"GEMINI_MODEL": "gemini-"}])
def test_values_that_do_not_fit(env):
    with pytest.raises(ValueError):
        load_settings("gemini-x", None, env)


def test_clusters_must_name_the_shared_folder():
    from polka.session import shared_dir

    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        def __init__(self, **conf):
            self.conf = Conf({k.replace("_", "."): v for k, v in conf.items()})

    assert shared_dir(Session(spark_master="yarn", spark_checkpoint_dir="hdfs:///x/")) == "hdfs:///x"
    local = Session(spark_master="local[4]")
    assert shared_dir(local) == shared_dir(local) == local.conf["spark.checkpoint.dir"]
    for master in ("yarn", "local-cluster[3,2,3000]", "spark://host:7077"):
        with pytest.raises(RuntimeError, match="checkpoint"):
            shared_dir(Session(spark_master=master))
