"""Card numbers with other numbers next to them."""

from __future__ import annotations

import pytest

from tracewell.llm import pii

ODD = {
    "card, expiry and code": "pay with 4111 1111 1111 1111 12 25 123 now",
    "two cards": "cards 4111 1111 1111 1111 5500 0000 0000 0004 now",
    "a number before": "card 12 4111 1111 1111 1111 now",
    "a year before": "card 2025 4111 1111 1111 1111 now",
    "a table": "card " + "1234 5678 " * 30 + "4111 1111 1111 1111 now",
    "without spaces": "card 4111111111111111 12 25 123 now",
    "another separator": "card 4111 1111 1111 1111-12 25 now",
}
CARDS = ("4111 1111 1111 1111", "5500 0000 0000 0004", "4111111111111111")


@pytest.mark.parametrize("name", sorted(ODD))
def test_cards_in_longer_runs_are_candidates(name):
    found = {ODD[name][s:e] for s, k, e, _, base in pii.scan(ODD[name])[1] if k == 2 and not base}
    assert {c for c in CARDS if c in ODD[name]} <= found


def test_redact_leaves_no_card(spark):
    seen = ["pay by card 4111 1111 1111 1111 please", "card 5500 0000 0000 0004, mail jo@mail.example.com or +1 (212) 555-0123"]
    rows = [(i, t) for i, t in enumerate(seen * 20 + list(ODD.values()))]
    clean = [r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert not [t for t in clean if any(c in t for c in CARDS)]
    assert "pay with [CARD] 12 25 123 now" in clean and "cards [CARD] [CARD] now" in clean


def test_candidates_keep_base_spans():
    text = "4111 1111 1111 1111 and 4111 1111 1111 1111 12 25 123"
    assert [(text[s:e], base) for s, _, e, _, base in pii.scan(text)[1]] == [(CARDS[0], True), (CARDS[0], False)]
