"""Personal data in forms that no fixed form covers."""

import random

from tests.llm.edges import documents
from weblake.llm import pii

MISSED = [
    ("Call me: (555) 123-4567 today", "phone:9:23"), ("Call me: 0049 30 1234567 today", "phone:9:24"),
    ("Call me: +49/30/1234567 today", "phone:9:23"), ("Mail me: jürgen@müller.example today", "email:9:30"),
    ("Card: 4111.1111.1111.1111 today", "card:6:25"), ("Card: 4111  1111  1111  1111 today", "card:6:28"),
    ("Card: 4111/1111/1111/1111 today", "card:6:25"),
]
#: The fixed form covers the ASCII end of the local part; the letters before it are a span of their own.
SPLIT = ("Mail me: zoë.x@mail.example today", ["email:9:12", "email:12:27"])
REFUSED = ["Order (555) 123-4567 of room 3", "Order 1234-5678-9012 of room 3", "Card: 4111.1111.1111.1112 today", "ratio 3.141592653589793 today"]


def test_missed_forms_are_taken_in_known_surroundings(spark):
    random.seed(10)
    texts = [t for t, _ in MISSED] + [SPLIT[0]] + REFUSED
    n = len(texts)
    texts += [f"Call me: +{random.randint(1, 9)} ({random.randint(100, 999)}) 555-{random.randint(1000, 9999)} today" for _ in range(100)]
    texts += [f"Mail me: x{i}@mail{i}.example.com today" for i in range(100)]
    texts += ["Card: 4111 1111 1111 1111 today"] * 60
    texts += [f"Order ({random.randint(200, 999)}) {random.randint(100, 999)}-{random.randint(1000, 9999)} of room 7" for _ in range(100)]
    found = {r.doc_id: r.spans for r in pii.digest(pii.find(documents(spark, list(enumerate(texts))))).collect()}
    got = [found[i] for i in range(n)]
    assert got[:len(MISSED)] == [span for _, span in MISSED]
    assert got[len(MISSED)].split(",") == SPLIT[1]
    assert got[len(MISSED) + 1:] == [""] * len(REFUSED)
    assert all(not found[i] for i in range(len(texts) - 100, len(texts)))
