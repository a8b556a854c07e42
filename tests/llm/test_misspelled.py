"""A lone misspelled term, scored by a learned model."""

import random

from lattica.llm import toxicity


def rows(clean_form=None):
    rng = random.Random(5)
    plain = lambda: [f"{a}{b}" for a, b in zip(rng.choices("bdgklm", k=30), rng.choices(range(500), k=30), strict=True)]
    out = [(" ".join([*plain(), "grumblefoot", "snarkle"]), 1) for _ in range(60)]
    return out + [(" ".join([*plain(), *([clean_form] if clean_form else [])]), 0) for _ in range(400)]


def test_unseen_misspelling_is_found():
    model = toxicity.learn(rows())
    assert {"grumblefoot", "snarkle"} <= model.words.keys() and not model.fuzzy
    s = toxicity.Scorer(model)
    exact, one, two = (s.score(f"b1 d2 what a {w} k3 m4") for w in ("grumblefoot", "grumblefoat", "grumbelfoot"))
    assert exact > one > two >= toxicity.THRESHOLD
    assert s.score("b1 d2 what a snarkel k3 m4") < toxicity.THRESHOLD  # two edits are too many for seven letters
    assert s.score("b1 d2 what a snarkl k3 m4") >= toxicity.THRESHOLD


def test_form_of_clean_rows_stays_low():
    s = toxicity.Scorer(toxicity.learn(rows("grumblefort")))
    assert s.score("b1 d2 what a grumblefort k3 m4") < toxicity.THRESHOLD


def test_long_tokens_take_linear_time():
    import time

    began = time.time()
    assert toxicity.core("a" + "-" * 1_000_000 + "b") == "a" + "-" * 1_000_000 + "b"
    assert toxicity.core("-" * 1_000_000) == "" and toxicity.core("!!¡¡" + "x" + "!" * 1_000_000) == "!!¡¡x"
    assert time.time() - began < 2


def test_order_of_rows_makes_no_difference():
    import random

    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(" ".join([*(word() for _ in range(30)), *(["nastyterm"] if i % 3 == 0 else [])]), int(i % 3 == 0)) for i in range(120)]
    rows += [(rows[0][0] + " more", 1)] * 40
    one = toxicity.learn(rows)
    r.shuffle(rows)
    assert toxicity.learn(rows) == one and set(one.words) == {"nastyterm"}


def test_quoted_share_is_learned():
    rows = [(f"you are a nastyterm {i} {i + 1} {i + 2}", 1) for i in range(0, 3000, 10)] + [(f"plain text {i} {i + 7} here {i * 3}", 0) for i in range(0, 5000, 10)]
    without = toxicity.learn(rows)
    told = toxicity.learn([*rows, *((f'they said "nastyterm" about {i} and {i + 9}', 0) for i in range(20, 40, 10))])
    assert without.quoted == toxicity.QUOTED and told.quoted < without.quoted
    assert toxicity.Scorer(told).score('she wrote "nastyterm" here') < 0.7 < toxicity.Scorer(told).score("what a nastyterm")
