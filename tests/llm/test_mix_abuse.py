"""Mixtures keep caps and shares; scores find the judged examples and survive odd mails."""

from __future__ import annotations

import base64
import math
import quopri
import time

import pytest
from pyspark.sql import functions as F

from panelforge.llm import abuse, mail, mix
from panelforge.session import table

from abuse_sentences import ABUSIVE, HARMLESS, HELD_ABUSIVE, HELD_HARMLESS

SIZES = "doc_id long, source string, n_tokens long"
TARGETS = "source string, target_share double, max_repeats int"


def mixed(spark, sizes, targets, total=None):
    t, n = spark.createDataFrame(targets, TARGETS), spark.createDataFrame(sizes, SIZES)
    out = mix.mixture(n, t, total)
    return out, {r["source"]: r for r in mix.shares(n, out, t).collect()}


def test_shares_and_caps(spark):
    sizes = [(i, s, 50 + (i * 37) % 400) for s, lo, hi in (("a", 0, 3_000), ("b", 3_000, 3_600), ("c", 3_600, 3_640)) for i in range(lo, hi)]
    targets = [("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 3)]
    out, s = mixed(spark, [*sizes, (9_000, "other", 70), (9_001, None, 70)], targets)
    got = {r["source"]: r["most"] for r in out.groupBy("source").agg(F.max("copies").alias("most")).collect()}
    assert all(got[k] <= m for k, _, m in targets if k in got)
    assert s["none"]["share"] == 0.0 and s["c"]["most_copies"] == 4 and s["c"]["least_rate"] == 4.0
    assert s["other"]["n_docs"] == 1 and s["other"]["target_share"] is None and s[None]["tokens"] == 70
    for k, share, _ in targets[:3]:
        assert abs(s[k]["share"] / (share / 0.9) - 1) < 0.01 and abs(s[k]["wanted_share"] - share / 0.9) < 1e-9
    assert out.count() == len(sizes)


def test_rates_are_those_of_the_dual(spark):
    sizes = [(i, "a", 1 + (i * i) % 977) for i in range(500)] + [(1_000 + i, "b", 100) for i in range(50)]
    out, s = mixed(spark, sizes, [("a", 0.5, 3), ("b", 0.5, 4)])
    assert s["a"]["least_rate"] < s["a"]["most_rate"] < 1  # long documents are thinned more, none is lost
    rows = [r for r in out.collect() if r["source"] == "a"]
    mean = sum(r["n_tokens"] for r in rows) / len(rows)
    lam = {round(math.log(r["rate"]) * (r["n_tokens"] + mean) / r["n_tokens"], 6) for r in rows}
    assert len(lam) == 1
    assert abs(sum(r["rate"] * r["n_tokens"] for r in rows) - 20_000) < 1e-3


def test_growing_source_stops_at_the_cap(spark):
    sizes = [(i, "a", 10 + 90 * (i % 5)) for i in range(1_000)] + [(2_000 + i, "b", 1_000) for i in range(720)]
    out, s = mixed(spark, sizes, [("a", 0.5, 4), ("b", 0.5, 1)])
    assert s["a"]["most_rate"] == 4.0 and s["a"]["least_rate"] < 4.0 and s["a"]["most_copies"] == 4
    assert abs(s["a"]["share"] / 0.5 - 1) < 0.01


def test_long_documents_do_not_spoil_the_shares(spark):
    sizes = [(i, "a", 20_000 if i % 50 == 0 else 100) for i in range(400)] + [(1_000 + i, "b", 500) for i in range(40)]
    _, s = mixed(spark, sizes, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert abs(s["a"]["share"] - 0.5) < 0.005


def test_blocks_follow_the_source(spark, monkeypatch):
    monkeypatch.setattr(mix, "BLOCK_DOCS", 100)
    sizes = [(i, "big", 100) for i in range(3_000)] + [(9_000 + i, "small", 400) for i in range(20)]
    out, s = mixed(spark, sizes, [("big", 0.9, 1), ("small", 0.1, 2)], 40_000.0)
    assert out.where("source = 'small'").agg(F.sum("copies")).first()[0] == 10  # as one block: not ten or so draws
    assert abs(s["big"]["share"] - 0.9) < 0.01


def test_smaller_total_and_odd_rows(spark):
    sizes = [(i, "a" if i % 2 else "b", None if i == 4 else 100) for i in range(200)] + [(900, "b", 0), (901, "b", 100), (901, "b", 100)]
    out, s = mixed(spark, sizes, [("a", 0.25, 1), ("b", 0.75, 1), ("b", 0.75, 1), (None, 0.1, 1), ("a", None, 1)], 4_000.0)
    assert 3_800 <= sum(r["copies"] * (r["n_tokens"] or 0) for r in out.collect()) <= 4_200
    assert out.where("doc_id in (4, 900)").agg(F.sum("copies")).first()[0] == 0 and out.count() == 203


def test_nothing_to_mix(spark):
    out, s = mixed(spark, [], [("a", 1.0, 1)])
    assert out.count() == 0 and s["a"]["share"] == 0.0
    out, s = mixed(spark, [(1, "a", 5)], [])
    assert out.count() == 0 and s["a"]["n_docs"] == 1
    out, _ = mixed(spark, [(1, "a", 0), (2, "a", None)], [("a", 1.0, 1)])
    assert [r["copies"] for r in out.collect()] == [0, 0]


def examples(spark, data):
    return [tuple(r) for r in table(spark, data, "abuse_labels").select("snippet", "lang", "category", "abusive").collect()]


def figures(lex, rows):
    """(recall, precision) over judged rows."""
    said = [(lex.score(r[0])[0] >= abuse.THRESHOLD, bool(r[3])) for r in rows]
    both = sum(a and b for a, b in said)
    return both / max(1, sum(b for _, b in said)), both / max(1, sum(a for a, _ in said))


def templates(rows):
    """Number of the template of each row: rows of one language and verdict that share four words in a row."""
    root, first = list(range(len(rows))), {}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    plain = abuse.lexicon()
    for i, (snippet, lang, _, abusive) in enumerate(rows):
        words = plain.folded(snippet).split()
        for run in zip(words, words[1:], words[2:], words[3:]):
            root[find(i)] = find(first.setdefault((lang, abusive, run), i))
    return [find(i) for i in range(len(rows))]


def test_judged_examples_held_out_by_half(spark, data):
    rows = sorted(examples(spark, data))
    for k in (0, 1):
        recall, precision = figures(abuse.Lexicon(abuse.learn(rows[k::2])), rows[1 - k :: 2])
        assert recall >= 0.9 and precision >= 0.9


def test_judged_examples_of_unseen_templates(spark, data):
    rows = sorted(examples(spark, data))
    group = templates(rows)
    order = sorted(set(group))
    assert len(order) > 60
    for k in range(2):
        seen = set(order[k::2])
        recall, precision = figures(abuse.Lexicon(abuse.learn([r for r, g in zip(rows, group) if g in seen])), [r for r, g in zip(rows, group) if g not in seen])
        assert recall >= 0.9 and precision >= 0.9


def test_sentences_written_apart():
    lex = abuse.lexicon()
    for abusive, harmless in ((ABUSIVE, HARMLESS), (HELD_ABUSIVE, HELD_HARMLESS)):
        recall, precision = figures(lex, [(x, None, None, 1) for x in abusive] + [(x, None, None, 0) for x in harmless])
        assert recall >= 0.9 and precision >= 0.9


def test_examples_teach_names_and_turns():
    rows = [("The Zorbians are vermin.", "en", "hate", 1), ("Die Zorbians sind Ungeziefer.", "de", "hate", 1), ("Zorbians breed like rats", "en", "hate", 1), ("Paint the moon with your own sorrow", "en", "threat", 1), ("So paint the moon with your own sorrow!", "en", "threat", 1), ("The moon is full", "en", None, 0), (None, "en", None, 1), ("", None, None, None)]
    got = abuse.learn(rows)
    assert got.groups == ["zorbians"] and "paint the moon" in got.turns
    text = "Zorbians are dogs"
    assert abuse.lexicon().score(text)[0] < abuse.THRESHOLD <= abuse.Lexicon(got).score(text)[0]
    assert abuse.Lexicon(got).score("go and paint the moon with your own sorrow")[0] >= abuse.THRESHOLD
    assert abuse.learn([]).weights == abuse.WEIGHTS


def test_harmless_examples_lower_a_weight():
    got = abuse.learn([(f"The bastard number {chr(97 + i)} of this long list", "en", None, 0) for i in range(20)])
    assert got.weights["ambiguous"] < abuse.WEIGHTS["ambiguous"] and got.weights["idiom"] == abuse.WEIGHTS["idiom"]


def test_length_counts():
    lex, filler = abuse.lexicon(), "all is well here and the table is done. "
    assert lex.score("a bastard of a problem")[0] >= abuse.THRESHOLD > lex.score("a bastard of a problem " + filler * 800)[0]
    assert lex.score("you filthy bastard " + filler * 800)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize(
    "text",
    ["You 1d10t", "you i.d.i.o.t!", "you i d i o t", "you iiidiot", "you id_iot", "уou іdіоt", "you i***t", "you id​i​ot", "IDIOT", "you ＩＤＩＯＴ", "idiots", "p i e c e   o f   s h i t", "Verpiss dich", "Eres un imb�cil", "va te f0utre toi, c0nnard", "I will b.r.e.a.k. .y.o.u.r. .f.i.n.g.e.r.s"],
)
def test_disguises(text):
    assert abuse.lexicon().score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize("text", ["", " ", "Vermin control comes on Tuesday.", "idiocy is a term of the old register", "Stupid mistake of mine", "A C G T A C G T", "rs7175 and 7175 rows", "Please kill the hung process", "a*b*c", "***", "x" * 100_000, "I asked a dumb question", "That was stupid of me, I am such an idiot"])
def test_harmless(text):
    assert abuse.lexicon().score(text)[0] < abuse.THRESHOLD


OTHER_WORDS = [
    "I am going to smash your kneecaps.", "We will hunt you down.", "We know where your daughter goes.", "You will pay with your life for this.", "Someone should slit your throat.", "I hope you choke.",
    "Refugees are animals, the lot of them.", "Those people are parasites.", "They should all be gassed.", "They multiply like cockroaches.", "Chase them, they belong driven out of our country.",
    "Send me some nudes.", "I want you on your knees.", "I dream of my hands all over your body.", "Horny housewives waiting tonight.",
    "You useless liar.", "Shut your filthy trap.", "You are so stupid.", "Ich breche dir alle Knochen.", "Du wirst bluten.", "Die sind doch alle Parasiten, die gehören vergast.", "Schick mir mal deine Titten", "On va te crever.", "Ces gens sont des parasites.", "Tes fesses me plaisent", "Vamos a romperte los dientes.", "Todos son escoria.", "We weten waar je kinderen wonen.", "Ze moeten uitgeroeid worden.",
]


@pytest.mark.parametrize("text", OTHER_WORDS)
def test_threats_hate_and_harassment_in_other_words(text):
    assert abuse.lexicon().score(text)[0] >= abuse.THRESHOLD


@pytest.mark.parametrize(
    "text",
    ["I will approve the request without opening it first.", "Ha borrado la tabla en nuestro laboratorio", "A encore effacé la table dans notre équipe", "wenn du noch einmal schreibst", "I will send you the file and find you a desk.", "I will shoot you a note on where you work now.", "The mice are animals that should be kept apart.", "The cells breed like yeast.", "Your hands are full, and your children go well.", "Parasites were found in two samples.", "Waiting for your reply"],
)
def test_harmless_remnants_and_neighbours(text):
    assert abuse.lexicon().score(text)[0] < abuse.THRESHOLD


@pytest.mark.parametrize("unit", ["ab", "a ", "a.", "!", "$1", "*", "a*", "aaab", "= ", "<", "<style", "=?", "\n>", " ", "=3D", "é", "\u200b", "--b\n", "1a", "_a"])
def test_long_texts_take_linear_time(unit):
    text = "Subject: x\nContent-Type: text/html\n\naaa " + unit * (300_000 // len(unit))
    began = time.perf_counter()
    abuse.lexicon().score(mail.readable(text))
    assert time.perf_counter() - began < 8


def test_one_phrase_in_a_very_long_text():
    assert abuse.lexicon().score("all is well here. " * 40_000 + "you make me want to throw up")[0] >= abuse.THRESHOLD


def mime(body, coding, kind="text/plain; charset=utf-8"):
    return f"Subject: x\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed;\r\n boundary=\"b1\"\r\n\r\n--b1\r\nContent-Type: {kind}\r\nContent-Transfer-Encoding: {coding}\r\n\r\n{body}\r\n--b1--\r\n"


def test_parts_are_decoded():
    text = "Du Wichser, äh"
    b64 = base64.b64encode(text.encode()).decode()
    assert text in mail.readable(mime(b64, "base64"))
    assert "Du Wichser" in mail.readable(mime(b64[:-3], "base64"))
    assert text in mail.readable(mime(quopri.encodestring(text.encode()).decode(), "quoted-printable"))
    assert "Du Wichser" in mail.readable(mime("<p>Du <b>Wich</b>ser</p><style>x</style>", "7bit", "text/html"))
    assert "Wichser" not in mail.readable(mime(b64, "base64", "image/png"))
    assert "für" in mail.readable(f"Subject: =?utf-8?B?{base64.b64encode('für'.encode()).decode()}?=\n\nx")
    assert mail.readable("no header at all") == "no header at all" and mail.readable(None) == "" and mail.readable("\n\n") == "\n"
    assert "body" in mail.readable("From a@b Mon\nSubject: s\nContent-Type: multipart/mixed; boundary=zz\n\n--zz\n\nbody")
    nested = "Content-Type: multipart/mixed; boundary=a\n\n" + "--a\nContent-Type: multipart/mixed; boundary=a\n\n" * 50
    mail.readable(nested)


@pytest.mark.parametrize("depth", [12, 40, 2_000])
def test_parts_are_decoded_at_any_depth(depth):
    inner = "Content-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n" + base64.b64encode("Du Wichser, äh".encode()).decode()
    forwarded = "Subject: s\nContent-Type: message/rfc822\n\n" * depth + inner
    assert mail.readable(forwarded).endswith("Du Wichser, äh")
    parted = inner
    for i in range(min(depth, 100)):
        parted = f"Content-Type: multipart/mixed; boundary=b{i:05d}\n\n--b{i:05d}\n{parted}\n--b{i:05d}\n\nafter {i}\n--b{i:05d}--\n"
    text = mail.readable(parted)
    assert "Du Wichser, äh" in text and text.index("Wichser") < text.index("after 0") < text.index("after 11")


def test_quoted_and_wrapped():
    assert abuse.lexicon().score("> > You make me want\n> > to throw up, really")[0] >= abuse.THRESHOLD


def test_documents(spark):
    rows = [(1, "a", "you idiot", 1), (2, "a", None, 1), (3, None, "", 1), (4, "b", "fine", 1), (1, "a", "you idiot", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, score int")
    out = abuse.score_documents(docs)
    assert sorted((r["doc_id"], r["abusive"]) for r in out.collect()) == [(1, True), (1, True), (2, False), (3, False), (4, False)]
    per = {r["source"]: (r["n_docs"], r["n_abusive"], round(r["rate"], 3)) for r in abuse.rates(out).collect()}
    assert per == {"a": (3, 2, 0.667), "b": (1, 0, 0.0), None: (1, 0, 0.0)}
    assert abuse.score_documents(docs.limit(0)).count() == 0
    labels = spark.createDataFrame([(1, "en", "what a zibble you are today", 1, "insult"), (2, "en", "oh, what a zibble you are today", 1, "insult"), (3, "en", "fine", 0, None), (4, None, None, None, None)], "snippet_id long, lang string, snippet string, abusive int, category string")
    more = spark.createDataFrame([(1, "a", "what a zibble you are today!")], "doc_id long, source string, text string")
    assert not abuse.score_documents(more).first()["abusive"] and abuse.score_documents(more, labels).first()["abusive"]
    assert abuse.score_documents(more, labels.limit(0)).count() == 1
