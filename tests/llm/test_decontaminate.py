from sightline.llm import decontaminate as D
from sightline.llm.kernels import hash_spans, spans

ITEM = "A train leaves Boston at 40 miles per hour and later Alice buys 12 apples for 3 dollars while Bob walks home slowly"

PLAIN = "How many hours does it take to fill the tank when both pipes are open at once and nothing leaks"


def run(spark, docs, items):
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, item_id string, b string")
    out = D.decontaminate(frame, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["doc_id", "text", "b", "contaminated", "item_id", "cover"]
    return {r.doc_id: (r.contaminated, r.item_id) for r in out.collect()}


def test_reparameterised_questions(spark):
    changed = ITEM.replace("Boston", "Lisbon").replace("Alice", "Carol").replace("Bob", "Dave").replace("40 miles", "65 kilometers").replace("12", "1,400.5")
    mixed = "It is known that Ann and Bob met. Then Ann asked Bob for help with the long task and Ann paid Bob well for it"
    swapped = "It is known that Eve and Tom met. Then Tom asked Eve for help with the long task and Eve paid Eve well for it"
    docs = [(1, "before it. " + ITEM + " and after"), (2, "Some words here. " + changed), (3, "A train leaves at once, and nobody walks home slowly"), (4, None), (5, ""), (6, PLAIN.upper()), (7, swapped), (None, ITEM)]
    got = run(spark, docs, [(10, ITEM), (11, ITEM), (12, mixed), (None, "x"), (13, None), (14, ""), (15, PLAIN)])
    assert got == {1: (True, 10), 2: (True, 10), 3: (False, None), 4: (False, None), 5: (False, None), 6: (True, 15), 7: (False, None), None: (False, None)}


def test_short_items_repeats_and_empty_tables(spark):
    got = run(spark, [(1, "well alpha beta gamma then"), (1, "other"), (2, "alpha gamma")], [(5, "Alpha beta gamma")])
    assert got == {1: (True, 5), 2: (False, None)}
    assert run(spark, [], [(1, ITEM)]) == {} and run(spark, [(1, ITEM)], []) == {1: (False, None)}


def test_pieces_do_not_change_the_template(monkeypatch):
    from sightline.llm import kernels

    text = (ITEM + ". The end of Paris? No.\n").encode() * 60
    whole = D.Template(text)
    monkeypatch.setattr(D, "pieces", lambda t: kernels.pieces(t, 50))
    cut = D.Template(text)
    assert (whole.kind == cut.kind).all() and (whole.token == cut.token).all()
    assert {1, 2, 3} <= set(whole.kind.tolist())


def brute(docs, items):
    """Windows in plain sets, over the same templates; slots by dictionaries."""
    out = set()
    made = {i: D.Template(t.encode()) for i, t in items}
    for d, t in docs:
        doc = D.Template((t or "").encode())
        tokens = doc.token.tolist()
        for i, item in made.items():
            n = min(D.WIDTH, len(item.token))
            wanted = {tuple(item.token[a : a + n].tolist()) for a in item.windows(n)[0]} if n else set()
            at = [a for a in range(len(tokens) - n + 1) if tuple(tokens[a : a + n]) in wanted]
            if wanted and len({tuple(tokens[a : a + n]) for a in at}) >= D.COVER * len(wanted):
                out.add((d, i))
    return out


def test_query_matches_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = {r.doc_id for r in D.op5_decontamination(spark, sf).collect()}
    assert got == {d for d, _ in brute(docs, items)} and got
    assert {d for d, t in docs for _, b in items if b in t} <= got


def test_unit_hashes():
    import numpy as np

    data = np.frombuffer(b"km", np.uint8)
    assert hash_spans(data, *spans(data))[0] in D._units


TWICE = "Every day Tom has 3 apples and Ann has 5 apples and Bob has 7 apples and nobody else has any fruit"


def test_an_occurrence_is_judged_for_itself(spark):
    """What else a document holds, and windows that an item repeats, do not clear a copy."""
    other = TWICE.replace("Tom", "Eve").replace("3", "44")
    inserted = TWICE.replace("and nobody", "and of course nobody")
    crossed = "Every day Tom has 3 apples and Tom has 5 apples and Tom has 7 apples and nobody else has any fruit"
    changed = ITEM.replace("Boston", "Lisbon").replace("40", "65")
    docs = [(1, "See: " + TWICE), (2, TWICE + ". Then it went on. " + other), (3, other), (4, "so " + inserted), (5, crossed)]
    docs += [(6, ITEM + ". " + changed), (7, ITEM + ", but a train leaves Madrid at 9 miles an hour"), (8, "None of it. " * 3), (9, TWICE), (9, "And " + other)]
    got = run(spark, docs, [(1, TWICE), (2, ITEM), (3, "Another wording"), (3, ITEM)])
    assert got == {1: (True, 1), 2: (True, 1), 3: (True, 1), 4: (True, 1), 5: (False, None), 6: (True, 2), 7: (True, 2), 8: (False, None), 9: (True, 1)}


def test_names_that_begin_sentences(spark):
    apples = "Tom has 3 apples. Ann has 5 apples. How many in total?"
    docs = [(1, apples.replace("Tom", "Carol").replace("Ann", "Eve")), (2, "Well then. " + apples.replace("Tom", "Carol").replace("Ann", "Eve").replace("3", "17") + " Good."), (3, "Pears has 3 colours. How nice in total"), (4, apples)]
    docs += [(5, "Bob likes Ann. Bob paid the long bill at once. Ann thanked Bob for it"), (6, "Eve likes Tom. Tom paid the long bill at once. Eve thanked Eve for it"), (7, "Eve likes Tom. Eve paid the long bill at once. Tom thanked Eve for it")]
    got = run(spark, docs, [(1, apples), (2, docs[4][1])])
    assert got == {1: (True, 1), 2: (True, 1), 3: (False, None), 4: (True, 1), 5: (True, 2), 6: (False, None), 7: (True, 2)}


def test_items_of_numbers_and_names_are_found_as_they_stand(spark):
    items = ["What does 48 Boston 12 km Rome 9 Lima 7 kg Oslo 5 give", "12 + 30 = 42 7 8 9"]
    docs = [(1, "So: what does 48 Boston 12 km Rome 9 Lima 7 kg Oslo 5 give, they asked."), (2, "sums: 12 + 30 = 42 7 8 9 10"), (3, "what does 49 Boston 13 km Rome 8 Lima 6 kg Oslo 4 give"), (4, "12 + 31 = 43 7 8 9")]
    out = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {r.doc_id: r.item_id for r in out.collect()} == {1: 0, 2: 1, 3: None, 4: None}


def test_numbers_that_come_to_be_equal(spark):
    """Equal numbers, in the item or in the copy, and number words do not clear a copy; unlike names do."""
    buy = "Alice buys 12 apples for 3 dollars at the market and then walks home slowly with all of them"
    pens = "On the desk there are 4 red pens and 4 blue pens and the teacher wants to know how many there are"
    docs = [(1, buy.replace("12", "7").replace("3", "7")), (2, pens.replace("4 red", "6 red").replace("4 blue", "9 blue")), (3, buy.replace("12", "forty").replace("3", "twelve")), (4, pens.replace("4 red", "twenty five red"))]
    docs += [(5, "On the desk there are many red pens and a few blue pens"), (6, buy.replace("Alice", "Dave"))]
    assert run(spark, docs, [(1, buy), (2, pens)]) == {1: (True, 1), 2: (True, 2), 3: (True, 1), 4: (True, 2), 5: (False, None), 6: (True, 1)}
    assert not D.consistent([(D.NUM, 1, b) for b in range(3)]) and D.consistent([(D.NUM, 1, 5), (D.NUM, 2, 5)]) and not D.consistent([(D.NAME, 1, 5), (D.NAME, 2, 5)])


def test_windows_that_all_items_share(spark):
    """A common beginning makes no candidates of documents that have nothing else of an item."""
    words = "amber birch cedar delta ember fjord grove haven inlet jetty knoll larch maple north ocean pearl quartz river stone tulip".split()
    begin = "answer the following question with a single short word or with none at all if you do not know it"
    items = [(i, f"{begin} about the {w} and the old {words[i - 1]} of that {words[i - 2]} which nobody knew before the {words[i - 3]} came") for i, w in enumerate(words)]
    docs = [(100 + i, f"{begin} number {i}") for i in range(60)] + [(i, f"see {t} so it is") for i, t in items[:5]]
    assert {d: i for d, (bad, i) in run(spark, docs, items).items() if bad} == {i: i for i in range(5)}
