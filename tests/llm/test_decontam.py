import itertools
import random

from wayloom.llm import decontam as dc

ITEM = "A train leaves the old station with 120 people and after 3 hours it has covered 240 km while Maria waits at home for 3 letters"
BACK = "the river bends slowly around the quiet hill and nobody in the small town has ever asked why it does so every single spring"


def found(spark, docs, items=None):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(docs)], "doc_id long, text string, id string, hash int")
    b = spark.createDataFrame([(i, t, 7) for i, t in enumerate(items or [ITEM, BACK])], "item_id long, text string, doc_id int")
    return {int(r.id): r.item_ids for r in dc.contaminated(d, b).collect()}, dc.decontaminate(d, b)


class Plain:
    """The same rule by plain comparison of all windows of a text with all of an item."""

    def __init__(self, text):
        words = text.split()
        self.values = [dc.canonical(w)[2] for w in words]
        self.kind = []
        for i, w in enumerate(words):
            kind = dc.canonical(w)[0]
            first = i == 0 or dc.canonical(words[i - 1])[1]
            if (kind == dc.CAPITAL and first) or (kind == dc.UNIT and (i == 0 or dc.canonical(words[i - 1])[0] != dc.NUMBER)):
                kind = dc.PLAIN
            self.kind.append(kind)

    def form(self, p, width, form):
        """Words and placeholders of a window, the values in its slots, or None."""
        body, slots = [], []
        for i in range(p, p + width):
            slot = form != dc.WORDS and self.kind[i] != dc.PLAIN and not (form == dc.NUMBERS and self.kind[i] == dc.CAPITAL)
            body.append(self.kind[i] if slot else self.values[i])
            slots += [self.values[i]] if slot else []
        return (body, slots) if form == dc.WORDS or len(slots) + dc.LITERALS <= width else None


def holds(doc, item):
    d, t = Plain(doc), Plain(item)
    n = len(t.kind)
    width = min(n, dc.WINDOW)
    if not n or (n < dc.LEAST and len(d.kind) != n):
        return False
    for shift in range(1 - n, len(d.kind)):
        covered = set()
        for form in (dc.WORDS, dc.NUMBERS, dc.TEMPLATE):
            met, maps, firm = set(), {}, True
            for at in range(n - width + 1):
                if not 0 <= at + shift <= len(d.kind) - width:
                    continue
                a, b = t.form(at, width, form), d.form(at + shift, width, form)
                if a is None or b is None or a[0] != b[0]:
                    continue
                if a[1] == b[1]:
                    covered |= set(range(at, at + width))
                met |= set(range(at, at + width))
                for x, y in zip(a[1], b[1]):
                    firm &= maps.setdefault(x, y) == y
            if firm:
                covered |= met
        if len(covered) >= min(n, max(dc.WINDOW, min(dc.COVER, n - 4))):
            return True
    return False


def test_equals_brute_force(spark):
    rng = random.Random(5)
    names, units = ["Maria", "Robert", "Peter", "Ann"], ["km", "hours", "kg"]
    plain = "the a train leaves old station people after it has while waits at home for letters and then so".split()

    def text(n):
        out = []
        for _ in range(n):
            x = rng.random()
            out.append(rng.choice(names) if x < 0.1 else str(rng.randint(1, 30)) + rng.choice(["", "", ".", "kg"]) if x < 0.25 else rng.choice(units) if x < 0.32 else rng.choice(plain) + rng.choice(["", "", "", "."]))
        return " ".join(out)

    items = [text(rng.choice([2, 4, 6, 9, 14, 20, 25])) for _ in range(25)] + ["12 15 18 21 24 27 30 33 36", "Take 5 pens now", "Yes"]

    def changed(item):
        words = item.split()
        for _ in range(rng.randint(0, 4)):
            i = rng.randrange(len(words))
            words[i] = rng.choice([str(rng.randint(1, 30)), rng.choice(names), rng.choice(plain)])
        x = " ".join(words)
        return rng.choice([x, x, x.lower(), x.upper(), x.title()])

    docs = [" ".join([text(rng.randint(0, 10)), changed(rng.choice(items)), text(rng.randint(0, 10))]) for _ in range(150)]
    docs += ["Yes", "yes", "yes sir", "12 15 18 21 24 27 30 33 36", "TAKE 5 PENS NOW", "take 6 pens now", items[3]]
    got, _ = found(spark, docs, items)
    want = {i: [k for k, item in enumerate(items) if holds(d, item)] for i, d in enumerate(docs)}
    assert got == {i: k for i, k in want.items() if k} and len(got) > 40


def test_finds_copies_and_new_parameters(spark):
    new = ITEM.replace("120", "85").replace("240 km", "99 km").replace(" 3 ", " 7 ").replace("Maria", "Peter")
    broken = ITEM.replace("after 3 hours", "after 4 hours").replace("for 3 letters", "for 9 letters")
    docs = [
        f"some words before. {ITEM} and after", "clean text about " + "nothing much in particular " * 9, new, broken, f"Intro: {BACK.upper()}", " ".join(ITEM.split()[:9]), BACK + "\n" + ITEM,
        ITEM.lower(), ITEM.title(), ITEM.lower().replace("120", "7").replace("240", "9"),
    ]
    got, kept = found(spark, docs)
    assert got[0] == [0] and got[2] == [0] and got[4] == [1] and got[6] == [0, 1] and got[7] == got[8] == got[9] == [0]
    assert 1 not in got and 5 not in got
    assert {r.doc_id for r in kept.collect()} == {1, 5} | ({3} - set(got))


def test_slots_have_to_be_consistent(spark):
    item = "take the same number 5 once more and add the same number 5 to the total of all the marbles"
    other = item.replace(" 5 ", " 8 ", 1).replace(" 5 ", " 6 ")
    got, _ = found(spark, [other, item.replace(" 5 ", " 9 ")], [item])
    assert got == {1: [0]}


def test_one_changed_name_hides_no_copy(spark):
    item = "every day at noon the cook asks Robert for more salt because the soup is plain and then the waiter tells Robert that the guests have left"
    got, _ = found(spark, [item.replace("Robert", "Peter", 1), item.replace("Robert", "Peter", 1).replace("soup", "stew").replace("guests", "people")], [item])
    assert got == {0: [0]}


def test_short_and_slot_heavy_items(spark):
    items = ["What is the capital of France?", "sum 12 15 18 and 21 24 27 and 30 33 36", "take 2 red apples and 3 green pears out of the big old basket by the door", "Take 5 pens now"]
    docs = [f"Some words. {items[0]} Paris.", f"quiz: {items[1]} now", items[2].replace(" 2 ", " 4 ").replace(" 3 ", " 4 "), "sum 1 2 3 and 4 5 6 and 7 8 9", "What is the capital?", "so take 5 pens now please"]
    got, kept = found(spark, docs, items)
    assert got == {0: [0], 1: [1], 2: [2], 5: [3]} and {r.doc_id for r in kept.collect()} == {3, 4}


def test_templated_benchmark(spark):
    """Each of many items is found whose windows all are those of other items, too."""
    rng = random.Random(3)
    slots = [["red", "blue", "green"], ["north", "south", "east"], ["apple", "pear", "plum"], ["slow", "quick", "steady"]]
    text = lambda pick: "a {} cart went {} along the road that leads past the market with a load of {} and came back by {} steps at the end of day".format(*pick)
    every = [text(p) for p in itertools.product(*slots)]
    items = spark.createDataFrame(list(enumerate(every)), "item_id long, text string")
    asked = rng.sample(range(len(every)), 30)
    docs = spark.createDataFrame([(k, f"before {k} there was this : {every[i]} and then {k} more came") for k, i in enumerate(asked)], "doc_id long, text string")
    got = {int(r.id): r.item_ids for r in dc.contaminated(docs, items).collect()}
    assert all(i in got[k] for k, i in enumerate(asked))


def test_common_preamble(spark):
    """Many items with one preamble: what they share is reported once, what is an item's own for that item."""
    lead = "Read the passage below with care and then choose the one best answer to the question that comes after it:"
    tails = [f"alpha{i} beta{i} gamma{i} delta{i}" for i in range(40)]
    items = spark.createDataFrame([(i, f"{lead} {t}") for i, t in enumerate(tails)], "item_id long, text string")
    docs = spark.createDataFrame([(1, lead), (2, f"{lead} {tails[7]}"), (3, tails[7])], "doc_id long, text string")
    ids = {r.item: r.item_id for r in items.selectExpr("xxhash64(text) AS item", "item_id").collect()}
    got = {}
    for r in dc.matches(docs, items).collect():
        got.setdefault(int(r.id), {})[ids[r.item]] = r.words
    assert 3 not in got and got[2][7] == 24
    assert len(got[1]) == 40


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, ITEM), (None, "clean"), (5, ITEM), (5, "clean too"), ((1 << 60) + 1, BACK), (5, ITEM)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (1, BACK), (None, BACK), (None, None)], "item_id long, text string")
    got = {(r.id, tuple(r.item_ids)) for r in dc.contaminated(docs, items).collect()}
    assert got == {(None, (1,)), ("5", (1,)), (str((1 << 60) + 1), (1,))}
    assert sorted(r.text for r in dc.decontaminate(docs, items).collect()) == ["clean", "clean too"]


def test_odd_rows(spark, odd, none):
    b = spark.createDataFrame([(1, ITEM), (1, ITEM), (None, BACK), (2, None), (3, "")], "item_id long, text string")
    out = dc.decontaminate(odd, b)
    assert out.count() == odd.count() and out.columns == odd.columns
    assert dc.decontaminate(none, b).count() == 0
    assert dc.decontaminate(odd, b.limit(0)).count() == odd.count()
