"""Addresses that are written in another way are learned from those the base patterns take."""

import pytest

from inkspan.llm import personal


@pytest.fixture(scope="module")
def model(spark):
    names = ["jane", "john.doe", "a.smith", "mary_k", "info", "peter"]
    hosts = ["host.org", "mail.example.com", "uni.edu", "shop.net"]
    rows = []
    for k in range(1200):
        name, host = names[k % 6], hosts[k % 4]
        rows += [
            f"please mail {name}{k}@{host} today", f"we meet at {host} on day {k}", f"the sizes are {k % 9},{k % 7},{k % 5},{k % 11} each",
            f"from the server 10.{k % 200}.{k % 99}.{k % 7} at noon", f"part 2.{k % 9}.{k % 7}.{900 + k % 99} of the list",
            f"you can mail {name} [at] uni [dot] edu too",
        ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    return personal.fit(docs)


@pytest.mark.parametrize(
    ("text", "kind", "wanted"),
    [
        ("please mail jane [at] host [dot] org today", "email", "jane [at] host [dot] org"),
        ("please mail jane(at)mail(dot)host.org today", "email", "jane(at)mail(dot)host.org"),
        ("please mail jane at host dot org today", "email", "jane at host dot org"),
        ("from the server 10,20,30,4 at noon", "ip", "10,20,30,4"),
    ],
)
def test_spelt_out_addresses_are_added(spark, model, text, kind, wanted):
    found = personal.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().personal
    assert [(s.kind, text[s.start : s.end], s.base) for s in found] == [(kind, wanted, False)]


@pytest.mark.parametrize("text", ["we meet at host.org on day 7", "the sizes are 1,2,3,4 each"])
def test_others_are_not(spark, model, text):
    assert not personal.detect(spark.createDataFrame([(1, text)], "doc_id long, text string"), model).first().personal
