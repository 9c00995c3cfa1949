import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexigraph.llm import leakage, mixing, quality, scanned

BODY = "the envoy crossed the desert without a guide and the whole town was waiting before the northern gate of the market".split()


def chunks(spark, texts, headings=("La trêve et le pacte",), pages=(7, 8)):
    rows = [(f"c{i}", 1, t, list(headings), None, list(pages), "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id long, chunk_text string, chunk_headings array<string>, chunk_heading_full string, chunk_page_numbers array<int>, kind string, piece string")


def test_repair_pages(spark):
    good = [" ".join(BODY) + "." for _ in range(30)]
    bad = "the env-\noy crossed the de5ert without a guicle\n Page 7\nLA TRÊVE ET LE PACT3\nand the wai¬\n\n[8]\nting was long. The well-\nknown gate.\n   Next one begins.\n7   La trêve et le pacte\nxii"
    texts = [*good, *["the well-known gate, the well-known town"] * 4, bad, bad, "", None, "one line only"]
    got = scanned.repair_pages(chunks(spark, texts), "findings").filter("chunk_id = 'c34'").collect()
    by = lambda k: {r["piece"] for r in got if r["kind"] == k}
    assert by("broken_word") == {"envoy", "waiting"} and by("misread_word") == {"desert", "guide"}
    assert by("running_line") == {"Page 7", "LA TRÊVE ET LE PACT3", "[8]", "7   La trêve et le pacte", "xii"}
    whole = {r["chunk_id"]: r["repaired_text"] for r in scanned.repair_pages(chunks(spark, texts), "text").collect()}
    assert whole["c34"] == "the envoy crossed the desert without a guide and the waiting was long. The well-known gate.\n\nNext one begins."
    assert whole["c36"] == "" and whole["c37"] is None and whole["c38"] == "one line only"


def test_rare_words_are_read_whatever_the_shared_model_holds(spark):
    """The same findings whether the words of a corpus are in the model of all tasks or, being rare, come by joins."""
    good = [" ".join(BODY) + "." for _ in range(400)]
    rare = ["near the granary of old the envoy crossed the desert"] * 6 + ["near the grariary of old the envoy crossed", "the gran¬\nary of old was waiting", *["a half-built wall"] * 3, "a half-\nbuilt wall"]
    df = chunks(spark, good + rare)
    found = lambda **shares: {(r["chunk_id"], r["kind"], r["piece"]) for r in scanned.repair_pages(df, "findings", **shares).collect()}
    whole, cut = found(), found(word_share=0.001, pair_share=0.001)
    assert whole == cut and ("c406", "misread_word", "granary") in cut and ("c407", "broken_word", "granary") in cut and not any(c == "c411" for c, _, _ in cut)


def test_headings_come_from_the_document(spark):
    a = chunks(spark, ["some text here\nmore of it", "La trêve et le pacte\nthe text goes on"]).withColumn("chunk_headings", F.when(F.col("chunk_id") == "c0", F.col("chunk_headings")))
    assert [r["piece"] for r in scanned.repair_pages(a, "findings").collect()] == ["La trêve et le pacte"]
    assert scanned.repair_pages(a.limit(0), "findings").count() == 0


def test_suffix_array_against_sorting():
    rng = np.random.default_rng(1)
    ids = np.r_[rng.integers(0, 4, 300).astype("int32"), np.zeros(leakage.DEPTH, dtype="int32")]
    key = lambda i: tuple(ids[i : i + leakage.DEPTH])
    order = leakage.suffix_array(ids)
    assert sorted(order) == [i for i in range(300) if ids[i]]

    def cut(i):  # words after the first unknown one do not count
        k = key(i)
        return k[: k.index(0)] if 0 in k else k

    assert [cut(i) for i in order] == sorted(cut(i) for i in order)


def test_matches_against_brute_force():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    items = leakage.Items([(n, " ".join(rng.choice(words) for _ in range(40))) for n in range(3)])
    test = items.ids.tolist()
    flat = [rng.randrange(len(items.vocabulary) + 1) for _ in range(200)] + test[3:25] + [0] + test[50:70] + [0]
    ids = np.array(flat + [0] * leakage.DEPTH, dtype="int32")
    got = {(h, t, n) for h, t, n in zip(*map(np.ndarray.tolist, leakage.matches(ids, items)))}
    searched = set(items.suffixes.tolist())
    want = set()
    for h in range(len(flat)):
        for t in searched:
            n = 0
            while flat[h + n : h + n + 1] and test[t + n : t + n + 1] and flat[h + n] == test[t + n] and flat[h + n]:
                n += 1
            if n >= leakage.SEED and not (h and t and flat[h - 1] == test[t - 1] and t - 1 in searched):
                want.add((h, t, n))
    assert got == want


def test_find_leaks(spark):
    rng = random.Random(6)
    name = lambda: "".join(rng.choice("bdfghjklmn") + rng.choice("aeiou") for _ in range(4))
    items = [(n, " ".join(name() for _ in range(60))) for n in range(4)]
    w = items[2][1].split()
    noise = lambda n: " ".join(name() for _ in range(n))
    changed = [*w[:20], "changed", *w[21:40]]
    texts = {
        1: noise(30) + " " + items[0][1] + " " + noise(5), 2: noise(40), 3: noise(9) + ", " + " ".join(w[:14]).upper() + "! " + noise(3), 4: noise(9) + " ".join(["", *w[:12], ""]) + noise(9),
        5: " ".join(changed), 6: " ".join(w[:9]) + " " + noise(12) + " " + " ".join(w[9:18]), 7: None, 8: "", 9: noise(2000),
    }
    docs = spark.createDataFrame([(i, t, 0, 0) for i, t in texts.items()] + [(5, texts[5], 1, 1)], "doc_id long, text string, item_id int, words int")
    test = spark.createDataFrame([*items, (9, None), (10, "too short")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["words"] for r in leakage.find_leaks(docs, test).collect()}
    assert got == {(1, 0): 60, (3, 2): 14, (5, 2): 40, (6, 2): 18}
    assert leakage.find_leaks(docs.limit(0), test).count() == 0 == leakage.find_leaks(docs, test.limit(0)).count()
    assert leakage.clean_corpus(docs, leakage.find_leaks(docs, test)).count() == len(texts) - 4


def test_leaks_do_not_depend_on_the_other_documents(spark):
    rng = random.Random(7)
    name = lambda: "".join(rng.choice("bdfghjklmn") + rng.choice("aeiou") for _ in range(4))
    words = [[name() for _ in range(60)] for _ in range(4)]
    test = spark.createDataFrame([(n, " ".join(w)) for n, w in enumerate(words)], "item_id long, text string")
    noise = lambda n: " ".join(name() for _ in range(n))
    texts = [noise(5) + " " + " ".join(words[0][10:26]) + " " + noise(n) for n in range(30)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert {(r["doc_id"], r["words"]) for r in leakage.find_leaks(docs, test).collect()} == {(n, 16) for n in range(30)}
    pieces = " ".join(words[1][5:10]) + " " + noise(20) + " " + " ".join(words[1][10:15]) + " " + noise(20) + " " + " ".join(words[1][15:20])
    over = " ".join(words[2][-8:]) + " of " + " ".join(words[3][:8])  # the end of an item and the beginning of the next
    docs = spark.createDataFrame([(1, pieces), (2, over)], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["words"]) for r in leakage.find_leaks(docs, test).collect()] == [(1, 1, 15)]


def test_leaks_of_words_that_many_items_share(spark):
    rng = random.Random(9)
    name = lambda: "".join(rng.choice("bdfghjklmn") + rng.choice("aeiou") for _ in range(4))
    noise = lambda n: " ".join(name() for _ in range(n))
    shared = noise(20).split()
    test = spark.createDataFrame([(n, f"{noise(20)} {' '.join(shared)} {noise(20)}") for n in range(8)], "item_id long, text string")
    docs = [(1, f"{noise(9)} {' '.join(shared[2:16])} {noise(9)}"), (2, f"{noise(9)} {' '.join(shared[2:15])} {noise(9)}")]
    got = leakage.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), test).collect()
    assert sorted((r["doc_id"], r["item_id"], r["words"]) for r in got) == [(1, n, 14) for n in range(8)]


@pytest.mark.parametrize("counts", [{"a": 500, "b": 300, "c": 7, "d": 193}, {"a": 1}, {"a": 333, "b": 333, "c": 334}, {}])
def test_pfair_deviates_by_less_than_a_block(counts):
    order, seen, whole = mixing.pfair(counts), dict.fromkeys(counts, 0), sum(counts.values())
    assert len(order) == whole
    for slot, (s, i) in enumerate(order):
        assert seen[s] == i
        seen[s] += 1
        assert all(abs(seen[k] - n * (slot + 1) / whole) < 1 for k, n in counts.items())


def test_quotas():
    assert mixing.quotas({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5, "none": 0.0}, {"a": 1, "b": 3}) == {"a": 55, "b": 30}


def test_mix(spark):
    docs = [(i, " ".join(["word"] * (5 + i % 7)), "a" if i % 3 else "b") for i in range(300)] + [(900, None, "a"), (901, "", "a"), (902, "x", None), (903, "x", "untargeted"), (5, "same id again", "a")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, slot int, copy int")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 2), ("gone", 0.0, 3)], "source string, target_share double, max_repeats int")
    got = mixing.mix(df, targets, blocks=64).toPandas()
    assert got.groupby("doc_id").size().max() <= 2 and set(got.source) == {"a", "b"} and got["copy"].max() <= 2 and len(got[got.doc_id == 903]) == 0
    share = {r["source"]: r for r in mixing.shares(mixing.mix(df, targets, blocks=64), targets).collect()}
    assert share["a"]["actual_share"] == pytest.approx(0.5, abs=0.02) and share["gone"]["tokens"] == 0
    run = got.sort_values(["slot", "place"])
    lead = (run.tokens.where(run.source == "a", 0).cumsum() - run.tokens.where(run.source == "b", 0).cumsum()).abs().max()
    assert lead <= 2.5 * run.tokens.sum() / 64 + 2 * run.tokens.max()
    assert mixing.mix(df.limit(0), targets).count() == 0 == mixing.mix(df, targets.limit(0)).count()


def test_tokens_are_those_of_the_tokenizer(spark):
    df = spark.createDataFrame([("Selon Lawadgha, l'an 712.",), ("",), (None,)], "t string")
    got = [r["n"] for r in df.select(mixing.count_tokens(F.col("t")).alias("n")).collect()]
    assert got[0] > 5 and got[1:] == [0, None]


PROSE = "Selon la version la plus ancienne, le chef rassembla les artisans et les porteurs d'eau au marché, avec l'accord des deux partis. Les survivants quittèrent la ville avec une petite escorte, ce qui apaisa les esprits."


def sample():
    rng = random.Random(8)
    name = lambda: "".join(rng.choice("bdfghjklmn") + rng.choice("aiou") for _ in range(4)).title()
    verbs = ["prit la parole devant l'assemblée", "compta les tentes au lever du soleil", "quitta la ville avec une petite escorte", "refusa de livrer les réserves de grain", "reçut la garde du sanctuaire"]
    out = []
    for i in range(40):
        out.append(("prose", PROSE + f" En l'an {i}, {name()} {rng.choice(verbs)} avec {i} hommes. " + PROSE))
    for _ in range(6):
        rng.shuffle(verbs)
        out.append(("prose", ",\n".join(v.capitalize() for v in verbs) + ",\n\n" + "\n".join(verbs[::-1])))
        out.append(("list", "Index\n" + "\n".join(f"- {name()} ibn {name()}, {rng.randrange(300)}" for _ in range(20))))
        out.append(("list", "\n".join(f"{name()} al-{name()}" for _ in range(15))))
        out.append(("table", "\n".join(f"{name()};{name()};{rng.randrange(999)};{rng.randrange(99)}" for _ in range(12))))
        out.append(("table", "\n".join(f"| {name()} | {rng.randrange(999)} | {name()} |" for _ in range(12))))
        out.append(("junk", "".join(rng.choice("#$%&*@!{}[]<>|~ \n") for _ in range(300))))
        out.append(("junk", "quitta la ville avec une petite escorte " * 30))
        out.append(("junk", "\n".join(rng.choice(["Accueil", "Suivant", "Imprimer", "Connexion"]) for _ in range(60))))
    out += [("prose", "The name of the scribe is unknown."), ("prose", PROSE + "\n- un point\n- un autre\n" + PROSE), ("prose", PROSE.upper()), ("prose", "— Où est le chef ? demanda la femme.\n— Il est parti avec les autres, dit-il.\n— Alors nous attendrons ici."), ("junk", "   \n ")]
    return out


def test_text_types(spark):
    cases = sample()
    df = spark.createDataFrame([(i, t, "clash") for i, (_, t) in enumerate(cases)] + [(10_000, None, "clash")], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r["kind"] for r in quality.text_types(df).collect()}
    wrong = [(cases[i][0], k, cases[i][1][:60]) for i, k in got.items() if cases[i][0] != k]
    assert not wrong and len(got) == len(cases)
    assert quality.text_types(df.limit(0)).count() == 0


def test_statistics():
    s = dict(zip(quality.STATISTICS, quality.statistics("Le chef vint, et parla.\n- a b\n- c d")))
    assert s["words"] == 9 and s["lines"] == 3 and s["bullets"] == pytest.approx(2 / 3) and s["end_punctuation"] == pytest.approx(1 / 3)
    assert len(quality.statistics("")) == len(quality.STATISTICS)


def test_learning_separates_good_from_bad_functions():
    kinds = ["prose", "list", "junk"]
    patterns = [((1, 0, 0), 900), ((0, 1, 0), 60), ((0, 0, 1), 30), ((1, 0, 1), 10)]
    model = quality.learn(patterns, kinds)
    assert model["prior"]["prose"] > 0.8
    assert max(quality.KINDS, key=lambda k: quality.posterior((0, 1, 0), kinds, **model)[k]) == "list"


def test_tokens_of_all_texts_are_looked_up_without_functions_of_elements(spark, monkeypatch):
    from lexigraph.llm import scanned
    from lexigraph.scratch import Scratch

    plans, keep = {}, Scratch.keep

    def kept(self, df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return keep(self, df, name)

    monkeypatch.setattr(Scratch, "keep", kept)
    texts = ["the caravan came\tto the wells", "«caravan»\nreached the wells", "a cara-\nvan left", "the caravan, again", "«coravan»\tcame to the wells", "coravan\rleft"]
    chunks = spark.createDataFrame([(str(n), t) for n, t in enumerate(texts)], "chunk_id string, chunk_text string")
    grams = spark.createDataFrame([("caravan", 40), ("coravan", 2)], "gram string, n long")
    got = {r["chunk_id"]: r["counts"] for r in scanned.rare_counts(chunks, grams, 50).filter("odd").collect()}
    assert got == {"4": {"caravan": 40, "coravan": 2}, "5": {"caravan": 40, "coravan": 2}}
    assert "lambda" not in plans["hits"]
