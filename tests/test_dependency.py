"""Scopes over parses of real sentences, against a plain walk of the tree for random ones."""

import random

from termloom.operators import dependency

SCHEMA = "chunk_id int, i int, text string, lemma string, pos string, dep string, head int"
PARSES = {
    1: [("patient", "NOUN", "nsubj", 3), ("does", "AUX", "aux", 3), ("not", "PART", "neg", 3), ("show", "VERB", "ROOT", 3), ("fever", "NOUN", "dobj", 3)],
    2: [("absence", "NOUN", "ROOT", 0), ("of", "ADP", "prep", 0), ("reflexes", "NOUN", "pobj", 1)],
    3: [("without", "ADP", "ROOT", 0), ("seizures", "NOUN", "pobj", 0)],
    4: [("normal", "ADJ", "amod", 1), ("hearing", "NOUN", "ROOT", 1)],
    5: [("vision", "NOUN", "nsubj", 1), ("is", "AUX", "ROOT", 1), ("within", "ADP", "prep", 1), ("normal", "NOUN", "pobj", 2)],
    6: [("No", "DET", "det", 1), ("tremor", "NOUN", "ROOT", 1)],
    7: [("fever", "NOUN", "ROOT", 0)],
}
NEGATION, NORMALITY = ("no", "absence", "without"), ("normal",)


def frame(spark, parses):
    rows = [(c, i, text, text.lower(), pos, dep, head) for c, words in parses.items() for i, (text, pos, dep, head) in enumerate(words)]
    return spark.createDataFrame(rows, SCHEMA)


def test_sentences(spark):
    got = {r.chunk_id: (r.negated, r.normal, r.negated_scopes, r.normal_scopes) for r in dependency.statuses(frame(spark, PARSES), NEGATION, NORMALITY).collect()}
    assert got == {
        1: (True, False, ["not show: patient → fever"], []), 2: (True, False, ["absence → absence"], []), 3: (True, False, ["without → seizures"], []),
        4: (False, True, [], ["normal hearing"]), 5: (False, True, [], ["within normal ← is"]), 6: (True, False, ["No → tremor"], []), 7: (False, False, [], []),
    }


def plain(words, negation, normality):
    kids = lambda i: [k for k, w in enumerate(words) if w[3] == i and k != i]
    neg, norm = [], []
    for i, (text, pos, dep, head) in enumerate(words):
        if dep == "neg":
            subject = obj = None
            for k in kids(head):
                if words[k][2] in dependency.SUBJECTS:
                    subject = words[k][0]
                elif words[k][2] in dependency.OBJECTS:
                    obj = words[k][0]
            reach = " → ".join(x for x in (subject, obj) if x)
            neg.append(f"{text} {words[head][0]}" + (f": {reach}" if reach else ""))
        elif text.lower() in negation:
            near = [words[k][0] for k in kids(i) if words[k][2] in dependency.NEAR]
            neg.append(f"{text} → {(near or [words[head][0]])[0]}")
        if text.lower() in normality:
            of = [(words[k][0], words[g][0]) for k in kids(i) if words[k][2] == "prep" and words[k][0].lower() == "of" for g in kids(k) if words[g][2] == "pobj"]
            if pos == "ADJ":
                norm.append(f"{text} {words[head][0]}")
            elif dep == "pobj" and words[head][2] == "prep":
                norm.append(f"{words[head][0]} {text} ← {words[words[head][3]][0]}")
            elif of:
                norm.append(" ".join((text, *of[0])))
            else:
                norm.append(" ".join(w[0] for w in words[max(0, i - dependency.BEFORE) : i + dependency.AFTER + 1]))
    return neg, norm


def test_random_trees(spark):
    rng = random.Random(4)
    parses = {}
    for c in range(120):
        n = rng.randint(1, 12)
        parses[c] = [(rng.choice(["no", "normal", "of", "of", "a", "b", "c"]), rng.choice(["ADJ", "NOUN"]), rng.choice(["nsubj", "dobj", "prep", "pobj", "neg", "attr", "x"]), rng.randrange(n)) for _ in range(n)]
    got = {r.chunk_id: (r.negated_scopes, r.normal_scopes) for r in dependency.statuses(frame(spark, parses), NEGATION, NORMALITY).collect()}
    assert got == {c: plain(words, NEGATION, NORMALITY) for c, words in parses.items()}


def test_no_side_of_a_join_is_broadcast(spark):
    from termloom.plans import context

    from .conftest import SF

    plan = context.dependency_scopes(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
