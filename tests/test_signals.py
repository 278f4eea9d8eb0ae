"""Quotes are found in one pass over a line."""

import random

from lodestar.operators import signals
from lodestar.operators.signals import scan_quotes


def plain(text):
    """The rule as it reads, a mark at a time."""
    out = []
    for line in text.replace("\r\n", "\n").split("\n"):
        at = 0
        while at < len(line):
            close = signals.CLOSES.get(line[at])
            if close is None or line[at] == "'" and at > 0 and line[at - 1].isascii() and line[at - 1].isalnum():
                at += 1
                continue
            ends = [i for i in range(at + 1, len(line)) if line[i] == close and (len(line[:i]) - len(line[:i].rstrip("\\"))) % 2 == 0]
            if ends:
                out.append({"delimiter": line[at], "value": line[at + 1 : ends[0]]})
                at = ends[0] + 1
            else:
                if line[at] != "'":
                    out.append({"delimiter": line[at], "value": line[at + 1 :]})
                at += 1
    return out


def test_scan_equals_the_plain_rule():
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choices("ab 1\\\"'`“”„«»‘’\n\r", k=rnd.randint(0, 40)))
        assert scan_quotes(text) == plain(text), text


class Counted(str):
    """A line that counts how often one of its characters is looked at."""

    looks = 0

    def __getitem__(self, at):
        Counted.looks += 1
        return super().__getitem__(at)


def test_steps_grow_with_the_line(monkeypatch):
    def steps(line):
        Counted.looks = 0
        text = type("Text", (str,), {"replace": lambda s, *a: s, "split": lambda s, *a: [Counted(line)]})(line)
        found = scan_quotes(text)
        return Counted.looks, sum(len(q["value"]) for q in found)

    for unit in ("“a ", "\\" * 3 + '"', "' ", "„x” “", "“ "):
        small, large = (steps(unit * n) for n in (2_000, 16_000))
        assert large[0] <= 9 * small[0] and large[1] <= 9 * small[1] + 10_000


def test_a_long_rest_is_no_fragment(spark):
    from pyspark.sql import functions as F

    rows = [('say "' + "x" * 700,), ('say "' + " " * 600 + "short rest",), ('it is "an open end',)]
    got = spark.createDataFrame(rows, "t string").select(signals.exact_fragments(signals.quotes(F.col("t"))).alias("f")).collect()
    assert [r.f for r in got] == [[], ["short rest"], ["an open end"]]
