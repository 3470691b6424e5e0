"""Rounds of the connected components."""

from coachload.llm import components as cc


def _rounds(monkeypatch, spark, links):
    """The rounds that links take, and the answer."""
    written, own = [], cc.stored
    monkeypatch.setattr(cc, "stored", lambda df, name: written.append(name) or own(df, name))
    found = cc.components(spark.createDataFrame(links, "a long, b long"))
    return len(written) - 1, {r["node"]: r["root"] for r in found.collect()}


def test_stars_take_no_round(spark, monkeypatch):
    links = [(i, i // 10 * 10) for i in range(40)] + [(7, 0)] * 3 + [(20, 20)]
    rounds, found = _rounds(monkeypatch, spark, links)
    assert found == {i: i // 10 * 10 for i in range(40)}
    assert rounds == 0


def test_linked_stars_take_three_rounds(spark, monkeypatch):
    links = [(i, i // 10 * 10) for i in range(40)] + [(13, 4), (25, 13), (39, 20)]
    rounds, found = _rounds(monkeypatch, spark, links)
    assert found == dict.fromkeys(range(40), 0)
    assert rounds == 3   # a fourth one, that changes nothing, was needed to know it


def test_chain_and_ring(spark, monkeypatch):
    links = [(i, i + 1) for i in range(60)] + [(i, 100 + (i - 99) % 30) for i in range(100, 130)]
    _, found = _rounds(monkeypatch, spark, links)
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100)}


def test_no_links(spark, monkeypatch):
    assert _rounds(monkeypatch, spark, []) == (0, {})
