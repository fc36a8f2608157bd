"""Line dedup, quality rules, licences and decontamination: brute force, edge cases, clashing names."""

import random
import re

import pytest
from pyspark.sql import functions as F

from stayflow.llm import decontaminate, license, linededup, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WS = " \t\n\x0b\x0c\r"
LONG = "very long text " * 20_000


def docs(spark, texts, **more):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({k: F.lit(v) for k, v in more.items()})


def split_words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


# --- line dedup ---


def brute_dedup(rows):
    first, covered = {}, {}
    windows = []
    for i, t in rows:
        if t is None:
            continue
        lines = [x.strip(WS) for x in t.split("\n")]
        windows += [(tuple(lines[at : at + 3]), i, at) for at in range(len(lines) - 2) if any(lines[at : at + 3])]
    for w, i, at in sorted(windows, key=lambda x: (x[1], x[2])):
        first.setdefault(w, (i, at))
    for w, i, at in windows:
        if first[w] != (i, at):
            start = max(at, first[w][1] + 3) if first[w][0] == i else at
            covered.setdefault(i, set()).update(range(start, at + 3))
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in covered.get(i, ())) for i, t in rows}


def test_line_dedup_against_brute_force(spark):
    passage = "first line here\nsecond line here\nthird line here"
    long_line = " ".join(f"w{i}" for i in range(60))
    texts = [passage, f"intro\n{passage}\nend", "a\na\na\na\na", f"x\n{long_line}", f"{long_line}\ny", None, "", "\n\n\n\n", "\n\n\n\n", "first line here\nsecond line here\nother", passage, f"  first line here \nsecond line here\nthird line here\nfourth\nfifth", "third line here\nfourth\nfifth\nsixth", LONG]
    found = linededup.remove_repeats(docs(spark, texts))
    got = {r["doc_id"]: r["text"] for r in found.collect()}
    want = brute_dedup(list(enumerate(texts)))
    assert got == want
    assert got[1] == "intro\nend" and got[2] == "a\na\na" and got[10] == "" and got[8] == "\n\n\n\n"
    assert got[4] == texts[4]  # a long line by itself is no window
    stats = {r["doc_id"]: r["lines"] for r in found.collect()}
    assert stats[1]["n_removed"] == 3 and stats[5]["n_lines"] == 0


def test_line_dedup_odd_rows(spark):
    df = spark.createDataFrame([(None, "a\nb\nc"), (1, "a\nb\nc"), (1, "a\nb\nc"), (2, "x"), (2, "a\nb\nc\nd")], "doc_id long, text string").withColumns({c: F.lit(7) for c in ("id", "copy", "at", "gone", "lines", "all_lines", "a", "b")})
    got = linededup.remove_repeats(df)
    assert got.columns == [c for c in df.columns if c != "lines"] + ["lines"] and set(got.columns) == set(df.columns)
    rows = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["text"]) for r in got.collect())
    assert rows == [(False, 0, "a\nb\nc"), (True, 1, ""), (True, 1, ""), (True, 2, "d"), (True, 2, "x")]
    assert linededup.remove_repeats(df.limit(0)).count() == 0


# --- quality rules ---


def brute_quality(text):
    w = split_words(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    places = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if split_words(x)]
    failed = len(w) < 50 or 100 * len(places) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places), failed


def test_quality_figures_against_brute_force(spark):
    some = " ".join(f"wörd{i}" for i in range(60))
    texts = [None, "", " \t\n", "a b c a b c", some, some + "\n#$% é|<>&*\n" + "x y z\nx y z\nx y z", "a\x0bb\x0cc\rd", "one two", "a a a a a", "\n".join(["same line here"] * 30), "ünï code words stay together"]
    got = {r["doc_id"]: r["quality"] for r in quality.rules(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        q = got[i]
        assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"], q["base_failed"]) == brute_quality(t), i
        assert q["kept"] == (not q["base_failed"]) and q["text"] == t


def test_boilerplate_lines_and_depleted_documents(spark):
    name = lambda n: "".join(chr(97 + int(c)) for c in str(n))  # noqa: E731  digits count as one another in lines
    body = lambda i: " ".join(f"w{name(i)}x{name(k)}" for k in range(60))
    banner, big = "Accept all 17 cookies", " ".join(["menu"] + [f"m{k}" for k in range(70)])
    rows = [(i, f"{banner}\n{body(i)}", "en", "host", None) for i in range(30)]
    rows += [(100 + i, f"{big}\n{' '.join(f'u{name(i)}v{name(k)}' for k in range(55))}", "en", "host", None) for i in range(40)]
    rows += [(200 + i, f"{body(999)}\ncopy", "en", "host", None) for i in range(40)]  # copies of one text are one document
    rows += [(300, f"accept ALL 42 cookies\n{body(300)}", "en", "other", None), (301, f"accept ALL 42 cookies\n{body(301)}", "en", None, None)]
    got = {r["doc_id"]: r["quality"] for r in quality.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[3]["text"] == body(3) and got[3]["kept"] and got[3]["n_removed_lines"] == 1
    assert not got[101]["kept"] and not got[101]["base_failed"] and got[101]["n_removed_words"] == 71
    assert got[205]["kept"] and got[205]["n_removed_lines"] == 0
    assert got[300]["n_removed_lines"] == 0 and got[301]["kept"]


def test_lines_go_and_documents_are_rejected(spark):
    """The line rule acts at the size that queries are compared at, and rejects documents that the base rules keep."""
    found = quality.rules(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    q = found.select("quality.*").toPandas()
    assert (q["n_removed_lines"] > 0).sum() > 100 and ((~q["base_failed"]) & ~q["kept"]).sum() > 0
    assert (q["n_removed_words"][~q["base_failed"] & ~q["kept"]] > 0.25 * q["n_words"][~q["base_failed"] & ~q["kept"]]).all()


def test_quality_odd_rows(spark):
    df = docs(spark, ["a b", None, LONG]).withColumns({c: F.lit(1) for c in ("figures", "host_key", "bad_lines", "all_lines", "all_words", "n_words", "quality", "bad", "h")})
    got = quality.rules(df)
    assert set(got.columns) == set(df.columns) and got.count() == 3
    assert quality.rules(df.limit(0)).count() == 0
    twice = df.unionByName(df)
    assert quality.rules(twice).count() == 6


# --- licences ---


def brute_license(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = [x for x in re.split(license.SEPARATORS, low) if x]
    places = [(i, label) for label, p in license.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def text_of(label, at=0):
    return [t for k, t in license.TEMPLATES if k == label][at]


def test_licenses_against_brute_force(spark):
    mit = text_of("mit", 1)
    texts = [None, "", "CC BY cc-by CC\nBY cc by", "the GNU General Public License, version 3", "General public. License", "All rights reserved. all Rights RESERVED", "cc", "cc by nc", mit.upper(), "Released under the MIT License.", "ÉCC BY", "cc by " * 3000, LONG, "general public", "by cc by", "cc by cc"]
    got = {r["doc_id"]: r for r in license.scan(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_license(t), i
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert got[8]["labels"] == "mit" and got[8]["score"] == 1.0 == got[9]["score"] and got[9]["labels"] == "mit" and got[12]["score"] == 0.0


def edits_between(a, b):
    """Words put in, left out or changed between two lists of words, of the second any beginning and end left out."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        last, row[0] = row[:], i
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
    return min(row)


def test_license_labels_against_alignment(spark):
    """Against the edits between template and text: no label beyond a fifth of the words, and labels for lightly edited texts."""
    rng = random.Random(5)
    words_of = lambda t: [w for w in re.split(license.SEPARATORS, t.lower()) if w]
    texts, want = [], []
    for label, t in license.TEMPLATES:
        found = words_of(t)
        for share in (0, 0.04, 0.08, 0.4, 0.7):
            text = list(found)
            for i in rng.sample(range(len(text)), int(share * len(text)) if len(found) >= 20 else int(share > 0)):
                text[i] = rng.choice((f"other{i}", f"{text[i]} more", ""))
            texts.append(" ".join(["before", "it", *text, "after", "it"]))
            want.append((label, share < 0.1 and (len(found) >= 20 or share == 0)))
    shuffled = words_of(text_of("mit", 1))
    rng.shuffle(shuffled)
    texts += [" ".join(shuffled), "under the apache " * 6 + "the apache license " * 8, "the software is provided as is " * 80, " ".join(words_of(text_of("bsd", 1))[:90])]
    want += [("", False)] * 4
    for r in license.scan(docs(spark, texts)).collect():
        label, sure = want[r["doc_id"]]
        mine, labels = words_of(texts[r["doc_id"]]), set(filter(None, r["labels"].split(",")))
        near = {k for k, t in license.TEMPLATES if (e := edits_between(w := words_of(t), mine)) <= (int(0.2 * len(w)) if len(w) >= 20 else 0)}
        base = {k for k, p in license.PHRASES if edits_between(p.split(), mine) == 0}
        assert base <= labels <= near | base, (texts[r["doc_id"]], labels, near)
        assert not sure or label in labels, (r, label)


def test_license_occurrences_and_spam(spark):
    mit = text_of("mit", 1)
    late = "the apache license the apache license licensed under the Apache License, Version 2.0"
    got = [r["labels"] for r in license.scan(docs(spark, [mit + mit, "x " * 500 + mit + " y " + text_of("bsd", 1), late, "licensed under cc by nd"])).orderBy("doc_id").collect()]
    assert got == ["mit", "bsd,mit", "apache", "cc-by"]
    with pytest.raises(ValueError):
        license.scan(docs(spark, ["x"]), templates=(("one", "word"),))


def test_license_odd_rows(spark):
    df = spark.createDataFrame([(None, "cc by"), (1, "cc by"), (1, "cc by"), (1, "other")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("copy", "hash", "pos", "template", "votes", "words", "gram", "found_id")})
    got = sorted((r["doc_id"] or 0, r["n_base"]) for r in license.scan(df).collect())
    assert got == [(0, 1), (1, 0), (1, 1), (1, 1)]
    assert license.scan(df.limit(0)).count() == 0


# --- decontamination ---


@pytest.fixture(scope="module")
def items(spark):
    q = "Then Anna walks 12 km in 3 hours and Anna rests; how fast does Anna walk on average over the whole day?"
    return spark.createDataFrame([(1, q), (2, "a short one"), (3, None), (4, ""), (5, "six words are in this item"), (6, q)], "item_id long, text string")


def test_templates_catch_new_values_only_if_consistent(spark, items):
    same = "Then {a} walks {n} {u} in {h} hours and {b} rests; how fast does {a} walk on average over the whole day?"
    texts = [
        same.format(a="Boris", b="Boris", n=40, u="miles", h=8),
        same.format(a="Boris", b="Carl", n=40, u="miles", h=8),
        "intro words. " + same.format(a="Anna", b="Anna", n=12, u="km", h=3) + " more words " * 50,
        "x six words are in this item y",
        None,
        "",
        "a short one",
        LONG,
        "Then Boris walks 40 miles. Something else entirely follows here and goes on for a while.",
    ]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find(docs(spark, texts), items).collect()}
    assert set(got) == {(0, 1), (0, 6), (2, 1), (2, 6), (3, 5), (6, 2)}
    assert got[3, 5]["share"] == 1.0 and (got[3, 5]["first_word"], got[3, 5]["last_word"]) == (1, 6)
    kept = {r["doc_id"] for r in decontaminate.clean(docs(spark, texts), items).collect()}
    assert kept == {1, 4, 5, 7, 8}
    assert {r["doc_id"] for r in decontaminate.clean(docs(spark, texts), items, shortest=5).collect()} == {1, 4, 5, 6, 7, 8}


def test_occurrences_do_not_hide_each_other(spark, items):
    same = "Then {a} walks {n} {u} in {h} hours and {a} rests; how fast does {a} walk on average over the whole day?"
    plain, boris, carl = (same.format(a=a, n=n, u=u, h=h) for a, n, u, h in (("Anna", 12, "km", 3), ("Boris", 40, "miles", 8), ("Carl", 7, "yards", 5)))
    part = " and so on, how fast does Dora walk on average over the whole day?"
    later = boris.replace("; how fast", " a little while under the old green trees; how fast")
    mixed = "Then Boris walks 40 miles in 8 hours and Carl rests; how fast does Dora walk on average over the whole day?"
    texts = [f"{boris} {carl}", f"{plain} Again: {boris}", f"{carl}{part * 3}", later, f"{part * 3} {boris} {part}", mixed, f"{mixed} {mixed}"]
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.find(docs(spark, texts), items).collect()}
    assert set(got) == {(d, i) for d in range(5) for i in (1, 6)}
    assert (got[0, 1]["share"], got[0, 1]["first_word"]) == (1.0, 0)
    assert {r["doc_id"] for r in decontaminate.clean(docs(spark, texts), items).collect()} == {5, 6}


def slow_template(text):
    """[(token or kind of slot, value)] by a plain scan."""
    found, number = [], False
    for m in re.finditer(r"\d+(?:[.,]\d+)*(?:[eE][+-]?\d+(?![^\W_]))?|[^\W\d_]+|[$€£¥%°]", text or ""):
        raw, low = m[0], m[0].lower()
        if raw[0].isdigit():
            new = ["<n>", low, "digits"]
        elif low in decontaminate.NUMBERS:
            new = ["<n>", str(decontaminate.NUMBERS[low]), "word"]
        elif raw in decontaminate.SIGNS:
            new = ["<u>", low, ""]
        elif low in decontaminate.FUNCTION_WORDS:
            new = [low, "", ""]
        elif len(raw) > 1 and raw[0].isupper() and raw[1].islower():
            new = ["<p>", low, "name"]
        elif number:
            new = ["<u>", low.removesuffix("s") if len(low) > 2 else low, ""]
        else:
            new = [low, "", ""]
        if found and new[2] in ("word", "name") and found[-1][2] == new[2]:
            found[-1][1] += " " + new[1]
        else:
            found.append(new)
        number = new[0] == "<n>"
    return [(t, v) for t, v, _ in found]


def slow_find(texts, items, width=8, least=0.6):
    def windows(t, w):
        for i in range(len(t) - w + 1):
            part = t[i : i + w]
            yield i, tuple(part) if sum(not v for _, v in part) < 2 else tuple(x for x, _ in part)

    found = set()
    known = {i: slow_template(t) for i, t in items.items()}
    for d, text in enumerate(texts):
        mine = slow_template(text)
        for i, item in known.items():
            w = min(width, len(item))
            if not w:
                continue
            of = {}
            for p, x in windows(mine, w):
                of.setdefault(x, []).append(p)
            hits = sorted((q - p, q, p) for p, x in windows(item, w) for q in of.get(x, ()))
            for gap in (0, 3, len(item) // 2, 10**9):
                runs = []
                for h in hits:
                    if runs and h[0] - runs[-1][-1][0] <= gap:
                        runs[-1].append(h)
                    else:
                        runs.append([h])
                for run in runs:
                    covered = {p + k for _, _, p in run for k in range(w)}
                    pairs = {((item[p + k]), (mine[q + k])) for _, q, p in run for k in range(w) if item[p + k][1]}
                    if len(covered) >= least * len(item) and len({a for a, _ in pairs}) == len(pairs) == len({b for _, b in pairs}):
                        found.add((d, i))
    return found


QUESTIONS = (
    "{p} has {n} {u} and buys {m} more {u}. How many {u} does {p} have now that the shop is closed?",
    "A train leaves {p} at a speed of {n} km per hour and reaches {q} after {m} hours without a stop on the way. How far is {q} from {p}?",
    "If {p} can paint a fence in {n} days and {q} needs {m} days, how long do they need together when both work at the same pace?",
    "The price of a book rises from ${n} to ${m}. By what percent does the price rise, rounded to the nearest whole number?",
    "A tank holds {n} litres of water and a pipe fills it at {m} litres a minute; how long until the tank is full to the brim?",
    "{p} and {q} share {n} {u} in the ratio of their ages. {p} is {m} years old. How many does {q} get in the end?",
    "At a temperature of {n} °C the pressure is {m} Pa inside the vessel, find the volume of the gas that was let in before",
)


def asked(rng, template, n=None):
    words = ("apples", "coins", "marbles", "stamps", "shells", "cards")
    names = ("Maria", "Jon", "Anna Lee", "Boris", "Carla", "Ines", "Tom", "Yusuf", "Li Wei", "Zoë")
    p, q = rng.sample(names, 2)
    numbers = rng.sample([*map(str, range(2, 90)), "1,200", "3.5", "1e5", "2.5e3", "seven", "twenty five"], 2)
    return template.format(p=p, q=q, n=numbers[0], m=numbers[1], u=rng.choice(words))


def test_reparameterised_questions_are_found(spark):
    """Recall over random questions with other names, numbers and units, and precision over ones whose slots do not agree."""
    rng = random.Random(11)
    known = {i: asked(rng, q) for i, q in enumerate(QUESTIONS)}
    other = [(asked(rng, QUESTIONS[k % len(QUESTIONS)]), k % len(QUESTIONS)) for k in range(140)]
    fill = lambda: " ".join(rng.choices("lorem ipsum dolor sit amet elit sed".split(), k=30))
    texts = [f"{fill()}. {t} {fill()}" for t, _ in other]
    wrong = "{p} has {n} {u} and buys {m} more {v}. How many {w} does {q} have now that the shop is closed?"
    texts += [wrong.format(p="Ada", q="Bob", n=4, m=9, u="pens", v="cups", w="hats")]
    df = spark.createDataFrame(list(known.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs(spark, texts), df).collect()}
    assert got == slow_find(texts, known)
    assert sum((d, k) in got for d, (_, k) in enumerate(other)) / len(other) >= 0.9
    assert not any(d == len(other) for d, _ in got)


def test_decontamination_of_the_table_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = [r["text"] for r in rows]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs(spark, texts), items).collect()}
    assert got == slow_find(texts, {r["item_id"]: r["text"] for r in items.collect()}) and len(got) >= 3


def test_texts_of_many_numbers(spark):
    rng = random.Random(2)
    numbers = lambda n: " ".join(str(rng.randint(0, 99)) for _ in range(n))
    some = numbers(30)
    texts = [numbers(3000), numbers(3000), f"{numbers(500)} {some} {numbers(500)}", "Bo has 3 pens and 4 cups. " * 400]
    items = {1: some, 2: "Al has 5 nuts and 6 figs.", 3: numbers(3000)}
    df = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.find(docs(spark, texts), df).collect()}
    assert got == {(2, 1), (3, 2)} == slow_find(texts, items)


def test_bitmap_keeps_every_window(spark):
    df = spark.range(3000).select(F.xxhash64("id").alias("hash"))
    for most in (16, 29):
        m, words = decontaminate.bitmap(df, 3000, most)
        bits = [(r["hash"] % (1 << 64)) >> (64 - m) for r in df.collect()]
        assert all(int(words[b >> 6]) >> (b & 63) & 1 for b in bits) and int(sum(map(int.bit_count, map(int, words)))) == len(set(bits))
    assert not decontaminate.bitmap(df.limit(0), 0)[1].any()


def test_decontamination_odd_rows(spark, items):
    df = spark.createDataFrame([(None, "six words are in this item"), (1, "six words are in this item"), (1, "six words are in this item"), (1, "clean")], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("found_id", "copy", "hash", "slots", "item_id", "doc", "id", "place", "size")})
    assert decontaminate.find(df, items).count() == 2
    left = decontaminate.clean(df, items)
    assert left.columns == df.columns and [r["text"] for r in left.collect()] == ["clean"]
    assert decontaminate.clean(df.limit(0), items).count() == 0 and decontaminate.clean(df, items.limit(0)).count() == 4
