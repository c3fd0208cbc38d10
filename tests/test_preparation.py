import pytest
from pyspark.sql.types import StructType

from veilscribe.operators import preparation as P
from veilscribe.schemas import ENTITY


def test_columns_are_found(spark):
    assert P.audio_column(StructType.fromDDL("a int, b struct<bytes: binary, path: string>")) == "b"
    assert P.audio_column(StructType.fromDDL("wav string, audio string")) == "audio"
    assert P.text_column(["id", "sentence", "text"]) == "text" and P.text_column(["my_Transcript"]) == "my_Transcript"
    for call in (lambda: P.audio_column(StructType.fromDDL("a int")), lambda: P.text_column(["a"])):
        with pytest.raises(ValueError, match="column"):
            call()


def test_models_by_preference():
    def fails():
        raise OSError("gone")

    assert P.first_working(fails, lambda: "second")() == "second"
    with pytest.raises(OSError, match="gone"):
        P.first_working(fails)()


@pytest.mark.parametrize(("setting", "available", "index"), [(None, 1, -1), ("cpu", 1, -1), (2, 0, 2), ("1", 0, 1), ("cuda", 0, -1), ("cuda", 2, 0), ("cuda:1", 2, 1), ("tpu", 2, -1)])
def test_devices(setting, available, index):
    assert P.device_index(setting, available) == index


def test_labels_have_their_ids():
    assert len(P.LABELS) == 11 and (P.LABEL_IDS["O"], P.LABEL_IDS["B-NAME"], P.LABEL_IDS["I-ID"]) == (0, 1, 10)


def test_subword_records(spark):
    gold = spark.createDataFrame([("r", "en", "Ann Smith", [("NAME", "Ann Smith", 0, 9)]), ("s", None, None, None)], f"record_id string, language string, transcript string, entities array<{ENTITY}>")
    got = {r["record_id"]: r for r in P.subword_records(gold).collect()}
    assert got["r"]["labels"] == [-100, 1, 2, 2, -100] and got["r"]["attention_mask"] == [1] * 5 and got["s"]["labels"] == [-100, -100]
    assert sorted(r["fold"] for r in P.subword_folds(P.subword_records(gold), 2).collect()) == [0, 1]
