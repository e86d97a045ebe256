import re

from pyspark.sql import functions as F

from llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _luhn(digits):
    total = sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _base(text):
    out = []
    for order, (kind, pattern) in enumerate(PLAIN.items(), 1):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (12 <= len(digits) <= 19 and _luhn(digits)) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), order, m.end(), kind))
    return sorted(out)


TEXTS = [
    None, "", "a@b.c_d@e.f x@y a@b a..@-.- é𝄞@x.y ä foo.12@mail3.example.com, a@b.c@d.e", "1.2.3.4.5.6.7.8 256.1.1.1 001.0255.3.4 1.2.3 1.1.1.1", "4532 1326-4652876 4024132264652876 4539578763621486 0000 0000 0000",
    "+1 (319) 555-5132 +44 20 7946 0958. +1 +12 ++123456789 +1(((((((((2", "1" * 9000 + " " + "2 " * 3000 + "@" + "x" * 9000 + "@", "4111111111111111" + "a@b.co" + "+1 203 555 0100" * 2, "10.0.0.1 10.0.0.1",
]


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(1, ""), (2, TEXTS[2]), (None, TEXTS[3]), (2, TEXTS[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit(1))
    out = pii.find_pii(df).collect()
    got = sorted((str(r["doc_id"]), [tuple(s) for s in r["base"]]) for r in out)
    assert got == sorted((str(i), _base(t)) for i, t in rows)
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in out)


def test_contexts_of_seeds_find_new_identifiers(spark):
    rows = [(i, f"please write to my mailbox user{i}@host{i}.example.org today or later we met {i}x{i} there") for i in range(30)]
    rows += [(100, "please write to my mailbox john7[at]host today or later"), (101, "we saw room4417b there")]
    out = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[100] == [("email", 27, 40)] and out[101] == []
    assert all(len(out[i]) == 1 for i in range(30))


def test_empty_table(spark):
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_runs_of_digit_groups_are_candidates(spark):
    forms = ["212 555 0100", "(212) 555-0100", "1234 5678 9012", "212 (555) 0101", "212.555 0100", "1 2 34", "555-0199"]
    rows = [(i, f"you can ring number +1 212 555 {1000 + i} anytime in the week") for i in range(30)]
    rows += [(100 + i, f"you can ring number {f} anytime in the week") for i, f in enumerate(forms)]
    rows += [(200, "they had 12 34 56 sheep"), (201, "you can ring number 212 555 0100x anytime in the week"), (202, "you can ring number 1 2 anytime in the week")]
    out = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[100 + i] for i in range(len(forms))] == [[("phone", 20, 20 + len(f))] for f in forms]
    assert out[200] == out[202] == []
    assert all(len(out[i]) == 1 for i in range(30))


def test_long_runs_of_digit_groups(spark):
    rows = [(1, "12 " * 20000 + "x"), (2, "(1) " * 20000), (3, "1-" * 20000 + " 2")]
    assert all(r["spans"] == [] for r in pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect())


def test_recall_and_precision_of_discovery(spark):
    """Unseen identifiers in contexts that seeds have too, contexts shared with a few other words, and look-alikes elsewhere."""
    contexts = {
        "email": [("reach me at", "any time"), ("cc the mailbox", "for details"), ("from sender", "yesterday evening")],
        "phone": [("call my cell", "after six"), ("fax to", "before noon"), ("whatsapp number", "is best")],
        "card": [("charged to visa", "last week"), ("mastercard no.", "was declined"), ("debit from", "went through")],
        "ip": [("ping host", "from outside"), ("ssh into", "with care"), ("blocked address", "by rule")],
    }
    seed = {"email": "u{0}@h{0}.example.org", "phone": "+1 212 555 {1}", "card": "4111111111111111", "ip": "10.0.{2}.{3}"}
    unseen = {"email": "u{0}[at]h{0}", "phone": "(212) 555-{1}", "card": "4111-22{1}", "ip": "10-0-{2}-{3}x"}
    fill = lambda form, i: form.format(i, 1000 + i, i % 200, (7 * i) % 250)
    rows, planted, alike = [], set(), set()
    for kind, places in contexts.items():
        for left, right in places:
            for i in range(20):
                rows.append((len(rows), f"well {left} {fill(seed[kind], i) if kind != 'card' else _card(i)} {right} thanks"))
            for i in range(10):
                rows.append((len(rows), f"well {left} {fill(unseen[kind], 500 + i)} {right} thanks"))
                planted.add(len(rows) - 1)
            rows.append((len(rows), f"well {left} nobody {right} thanks"))
    for i in range(120):
        rows.append((len(rows), f"room {fill(list(unseen.values())[i % 4], 900 + i)} holds {i} sheep at gate {i}b"))
        alike.add(len(rows) - 1)
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    added = {r["doc_id"] for r in out if len(r["spans"]) > len(r["base"])}
    recall, precision = len(added & planted) / len(planted), len(added & planted) / max(1, len(added))
    assert recall >= 0.9 and precision >= 0.9, (recall, precision)
    kinds = {r["doc_id"]: {s["kind"] for s in r["spans"]} for r in out}
    assert sum(k in kinds[i] for i in planted for k in contexts if rows[i][1].split()[1] in {p[0].split()[0] for p in contexts[k]}) >= 0.9 * len(planted)
    assert not alike & added


def _card(i):
    digits = [4, *map(int, f"{i:014d}")]
    check = next(c for c in range(10) if _luhn("".join(map(str, [*digits, c]))))
    return "".join(map(str, [*digits, check]))
