"""What the driver's JVM has freed outside of its heap goes back to the system."""

from semirune.llm import common, secrets


def test_checkpoints_return_freed_memory(spark, monkeypatch):
    said = []
    monkeypatch.setattr(common, "_returned_at", float("-inf"))
    plain = common.return_freed
    monkeypatch.setattr(common, "return_freed", lambda s: said.append(plain(s)))
    assert [r[0] for r in common.checkpointed(spark.range(3)).collect()] == [0, 1, 2]
    common.checkpointed(spark.range(3))
    assert len(said) == 2 and "Trim native heap" in said[0] and said[1] is None  # the second comes too soon


def test_training_returns_freed_memory(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(secrets, "return_freed", calls.append)
    secrets.redact(spark.createDataFrame([(1, "password = q8Zr5tLw2x")], "doc_id long, text string"))
    assert calls == [spark]


def test_a_jvm_without_the_command_goes_on(spark, monkeypatch):
    monkeypatch.setattr(common, "_returned_at", float("-inf"))
    monkeypatch.setattr(common, "RETURN_COMMAND", "noSuchCommand")
    assert common.return_freed(spark) is None
    assert common.checkpointed(spark.range(2)).count() == 2
