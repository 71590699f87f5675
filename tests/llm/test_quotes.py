import random

from pyspark.sql import functions as F

import quoted
from careflow.llm.quotes import link_quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("root", "depth", "lines", "own", "level")})
    return link_quotes(df).orderBy("conv_id", "position").collect()


def test_levels_attributions_and_reply_order(spark):
    rows = [
        (1, 0, "user", "Hello there, friend.\nHow are you?"),
        (1, 1, "bot", "On Monday, Bob wrote:\n> Hello there, friend.\n> How are you?\n\nI am fine."),
        (1, 2, "user", "> > hello THERE friend\n> > how are you\n>\n> I am fine!\nGood to hear."),
        (1, 3, "bot", "> How are you?\nStill fine.\r\n"),
        (1, 4, "user", " >  Good to hear.\nThanks"),
        (1, 5, "bot", "> nobody said this\nhm"),
        (2, 0, "user", "> Good to hear.\nother conversation"),
    ]
    found = {(r["conv_id"], r["turn"]): r for r in linked(spark, rows)}
    assert {k: r["reply_to"] for k, r in found.items()} == {
        (1, 0): None, (1, 1): 0, (1, 2): 1, (1, 3): 0, (1, 4): 2, (1, 5): None, (2, 0): None,
    }
    assert found[1, 1]["body"] == "I am fine." and found[1, 3]["body"] == "Still fine."
    assert (found[1, 2]["max_level"], found[1, 2]["n_quotes"], found[1, 2]["n_linked"]) == (2, 2, 2)
    assert (found[1, 5]["n_quotes"], found[1, 5]["n_linked"]) == (1, 0)
    assert [r["turn"] for r in linked(spark, rows) if r["conv_id"] == 1] == [0, 1, 3, 2, 4, 5]
    assert found[1, 4]["depth"] == 3 and found[1, 4]["root"] == 0


def test_long_chains_and_random_trees_against_a_walk(spark):
    rng, rows, parent = random.Random(4), [], {}
    for t in range(150):
        up = t - 1 if t < 70 else rng.randrange(t) if t else None
        quote = "" if t == 0 or rng.random() < 0.1 and t > 70 else f"> unique words of turn {up}\n"
        parent[t] = up if quote else None
        rows.append((7, t, "u", f"{quote}unique words of turn {t}"))
    rng.shuffle(rows)
    found = {r["turn"]: r for r in linked(spark, rows)}

    def way(t):
        return [t] if parent[t] is None else [*way(parent[t]), t]

    for t, r in found.items():
        assert (r["reply_to"], r["root"], r["depth"]) == (parent[t], way(t)[0], len(way(t)) - 1)
        assert r["body"] == f"unique words of turn {t}"
    order = sorted(found, key=lambda t: (way(t)[0], len(way(t)), t))
    assert [r["turn"] for r in sorted(found.values(), key=lambda r: r["position"])] == order


def test_quoted_conversations_against_a_walk(spark):
    """With a small vocabulary windows and lines repeat; with a large one every link is the one that was meant."""
    for vocabulary in (4, 5000):
        rows, meant = quoted.conversations(25, seed=vocabulary, vocabulary=vocabulary)
        want = quoted.walk(rows)
        found = linked(spark, rows)
        names = ("reply_to", "root", "depth", "n_quotes", "n_linked", "max_level", "body")
        assert {(r["conv_id"], r["turn"]): tuple(r[n] for n in names) for r in found} == want
        order = [(r["conv_id"], r["turn"]) for r in found]
        assert order == sorted(want, key=lambda k: (k[0], want[k][1], want[k][2], k[1]))
        if vocabulary == 5000:
            assert {k: v[0] for k, v in want.items()} == meant
            assert all("wrote" not in v[6] and "On Mon" not in v[6] for v in want.values())


def test_broken_attributions_partial_lines_and_wrapped_lines(spark):
    said = "the quick brown fox jumps over\nthe lazy dog and runs away from\nall the hunters in the wood"
    rows = [
        (1, 0, "a", said),
        (1, 1, "b", "On Mon, Ann\nwrote:\n> brown fox\nyes"),
        (1, 2, "a", "> and runs away\n> from all the hunters\nindeed"),
        (1, 3, "a", "On the other hand it is late.\nAnn wrote:\n> brown\nno"),
        (1, 4, "b", "> On Mon, Ann wrote:\n> > lazy dog\n> yes\nwell"),
    ]
    found = {r["turn"]: r for r in linked(spark, rows)}
    assert {t: r["reply_to"] for t, r in found.items()} == {0: None, 1: 0, 2: 0, 3: None, 4: 1}
    assert [found[t]["body"] for t in (1, 2, 3, 4)] == ["yes", "indeed", "On the other hand it is late.\nno", "well"]
    assert (found[4]["n_quotes"], found[4]["n_linked"], found[4]["max_level"]) == (2, 2, 2)


def test_messy_rows(spark):
    rows = [
        (1, 0, None, None), (1, 1, "u", ""), (1, 1, "u", ""), (None, 0, "u", "said here"), (None, 1, "u", "> said here\nyes"),
        (None, None, "u", "> said here"), (3, 0, "u", "> "), (3, 1, "u", ">>>\n> ..."), (4, 2, "u", "same"), (4, 1, "u", "same"),
        (4, 3, "u", "> same\n" + "long text " * 20_000),
    ]
    found = linked(spark, rows)
    assert len(found) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in found}
    assert by[None, 1]["reply_to"] == 0 and by[None, None]["reply_to"] is None
    assert by[4, 3]["reply_to"] == 1  # the first to say it
    assert len(by[4, 3]["body"]) == len("long text " * 20_000) - 1
    assert linked(spark, rows[:3])[0]["body"] == ""
    assert link_quotes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_repeated_row_quotes_as_a_single_one(spark):
    said, quote = (1, 0, "a", "one two three four"), (1, 1, "b", "> one two\n> three four\nyes")
    names = ("turn", "reply_to", "root", "depth", "n_quotes", "n_linked", "max_level", "body")
    single, many = ([tuple(r[n] for n in names) for r in linked(spark, [said, *[quote] * n])] for n in (1, 5))
    assert single[1][:4] == (1, 0, 0, 1)
    assert many == [single[0], *[single[1]] * 5]


def test_whole_table_without_quotes(table):
    rows = link_quotes(table("conversations")).collect()
    assert len(rows) == table("conversations").count()
    assert all(r["reply_to"] is None for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r["conv_id"], []).append(r)
    for turns in by.values():
        turns.sort(key=lambda r: r["turn"])
        assert [r["position"] for r in turns] == list(range(1, len(turns) + 1))
