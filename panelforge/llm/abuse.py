"""Scores for abusive, hateful, threatening or sexually explicit language.

Method: a weighted lexicon matched by an Aho-Corasick automaton after folding homoglyphs, accents and digit substitutions
and undoing the usual disguises (letters set apart, masked, repeated or parted by a sign); exception phrases shield what
they cover; the weights found are normalised by length.

The automaton finds idioms and words with a role (``lexicon.py``); what a word weighs depends on the words around it: an
insult weighs more when said to someone, ``vermin`` only where people are said to be it, a verb of violence where someone
is to do it to the reader.  Judged examples refine the weights and add what the lexicon cannot know: names of groups and
repeated turns of phrase of the corpus.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from math import log10

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm import lexicon as X
from panelforge.llm.mail import readable

#: What each kind of find weighs before any example is seen (in log-odds; a text is abusive from ``THRESHOLD`` on).
WEIGHTS = {
    "idiom": 16.0, "slur": 16.0, "insult": 8.0, "insult_at": 16.0, "ambiguous": 5.0, "ambiguous_at": 16.0, "wretch_at": 16.0, "contempt_at": 8.0, "contempt": 2.2, "profanity": 2.5,
    "subhuman": 5.0, "subhuman_is": 16.0, "vermin_is": 16.0, "vermin_they": 3.0, "group_contempt": 16.0, "driven": 10.0, "violence_you": 16.0, "harm_body": 16.0,
    "lewd_yours": 16.0, "lewd_others": 5.0, "lewd": 2.0, "sex_you": 16.0, "sex": 2.0, "explicit": 5.0, "bare_you": 5.0, "bare": 1.0, "nearly": 5.0, "hint": 1.0, "learnt": 2.0,
}
THRESHOLD = 4.0
#: Turns of phrase learnt from examples never weigh more than this together.
LEARNT_MOST = 12.0
PLURALS = ("s", "es", "n", "en")

_HOMOGLYPHS = dict(
    zip(
        "авсԁеёҽєһніїјкӏмпոорԛгѕтυцѵԝхуүұʏзɑαβεηικνορτχɡıʟɴʀßøłđħœæ",
        ["a", "b", "c", "d", "e", "e", "e", "e", "h", "h", "i", "i", "j", "k", "l", "m", "n", "n", "o", "p", "q", "r", "s", "t", "u", "u", "v", "w", "x", "y", "y", "y", "y", "z"]
        + ["a", "a", "b", "e", "n", "i", "k", "v", "o", "p", "t", "x", "g", "i", "l", "n", "r", "ss", "o", "l", "d", "h", "oe", "ae"],
    )
)
_ZERO_WIDTH = "­͏᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
_FOLD = str.maketrans({**_HOMOGLYPHS, **{c: None for c in _ZERO_WIDTH}, "�": "*", "’": "'", "‘": "'", "´": "'", "`": "'", " ": " "})
_MARKS = re.compile("[̀-ͯ]+")
_QUOTE = re.compile(r"^[>|\s]+", re.M)
_BLANKS = re.compile(r"[ \t\r\f\v\n]+")
_APART = re.compile(r"(?<![a-z0-9])[a-z0-9](?:(?:[ .·_*-]| ?[.·_-] ?[.·_-]? ?|  +)[a-z0-9](?![a-z0-9])){2,}(?:[ .·_*-][a-z]{2,3}(?![a-z0-9]))?")
_PARTED = re.compile(r"(?<=[a-z0-9])[_|@~^'\\+=#$-](?=[a-z0-9])")
_ELIDED = re.compile(r"(?<![a-z0-9])(qu|[cdjlmnst])'(?=[a-z])")
_SIGNED = re.compile(r"(?<![a-z0-9|@+$!])[a-z0-9|@+$!]*[|@+][a-z0-9|@+$!]*")
_SIGNS = [str.maketrans("|@+$!", "iatsi"), str.maketrans("|@+$!", "latsi")]
_MASKED = re.compile(r"(?<![a-z0-9*])[a-z]+\*+[a-z]*(?![a-z0-9*])")
_DIGITS = re.compile(r"(?<![a-z0-9$!])(?=[a-z0-9$!]*[0-9$!])[a-z0-9$!]{2,}(?![a-z0-9])")
_LONG = re.compile(r"([a-z])\1\1+")
_LETTERS = re.compile(r"[a-z]*")
_OTHER = re.compile(r"[^a-z0-9*]+")
_LAST_WORD = re.compile(r"([a-z]+)[^a-z]*$")
_LEET = [str.maketrans("01345789$!", "oieastbgsi"), str.maketrans("01345789$!", "oleastbgsi")]




def base_letters(text: str) -> str:
    """Lower case, without accents, homoglyphs and zero-width characters."""
    text = text.lower()
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text.translate(_FOLD))).translate(_FOLD)
    return text


def words_only(text: str) -> str:
    return f" {_OTHER.sub(' ', _PARTED.sub('', _ELIDED.sub(r'\1 ', text))).strip()} "


def spelled_out(patterns: str) -> Iterator[str]:
    """Every phrase of patterns that are parted by semicolons."""
    for p in patterns.split(";"):
        p = re.sub(r"<(\w+)>", lambda m: f"({X.PARTS[m[1]]})", p)
        yield from _choices(p)


def _choices(p: str) -> Iterator[str]:
    """The innermost choice is taken first, so that choices may hold choices."""
    if m := re.search(r"\(([^()]*)\)", p):
        before, after = p[: m.start()], p[m.end() :]
        for c in m[1].split("|"):
            yield from _choices(before + c + after)
    else:
        yield p


@dataclass
class Learnt:
    """What judged examples add to the lexicon."""

    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS))
    turns: list[str] = field(default_factory=list)  # word triples that only abusive examples have
    groups: list[str] = field(default_factory=list)  # names of groups that are degraded


def _by_language(words: dict[str, str]) -> dict[str, frozenset[str]]:
    return {lang: frozenset(w.replace("-", " ") for w in words_only(base_letters(text)).split()) for lang, text in words.items()}


YOU, YOURS, BETWEEN, ARE, SOMEBODY, WANT, OTHERS, GROUPS, CONTEMPT, BODY = map(_by_language, (X.YOU, X.YOURS, X.BETWEEN, X.ARE, X.SOMEBODY, X.WANT, X.OTHERS, X.GROUPS, X.CONTEMPT, X.BODY))
EVERY_YOURS = frozenset().union(*YOURS.values())
KIN = frozenset(X.PARTS["kin"].split("|"))
ARTICLES = frozenset("the all these those die les los de diese deze".split())
THEY = frozenset("they these those sie ils ellos ze zij".split())
NOT = frozenset("not never t nicht nie pas jamais no nunca niet nooit".split())
OWN = [f" {words_only(base_letters(x)).strip()} " for x in X.OWN.split(";")]
OWN_AFTER = [f" {words_only(base_letters(x)).strip()} " for x in X.OWN_AFTER.split(";")]
OWN_BESIDE = frozenset("ich ik sorry im fui soy".split())
NEAR_CHARS, NEAR_WORDS = 96, 8


class Lexicon:
    """Automaton of the terms, and what is needed to recognise them in disguise."""

    def __init__(self, learnt: Learnt | None = None) -> None:
        self.learnt = learnt or Learnt()
        self.weights, self.group_names = self.learnt.weights, frozenset(self.learnt.groups)
        self.roles: dict[str, set[tuple[str, str]]] = defaultdict(set)
        self._fill()
        self.auto = ahocorasick.Automaton()
        for term, roles in self.roles.items():
            self.auto.add_word(term, (len(term), tuple(sorted(roles))))
        self.auto.make_automaton()
        # single strong words first: of several terms that a masked one may stand for, the first is taken
        plain = [t.strip() for t in sorted(self.roles, key=lambda t: (-self.strength(t), t.count(" "), t)) if self.strength(t) > 0]
        self.words = {w for t in plain for w in t.split()} | {w for words in (BODY, YOU, YOURS) for known in words.values() for w in known if len(w) > 2} | KIN
        self.longest = max(map(len, self.words))
        self.joined = ahocorasick.Automaton()
        for t in sorted(plain, key=len):
            for part in {t, *t.split()}:
                if len(part.replace(" ", "")) >= 4:
                    self.joined.add_word(part.replace(" ", ""), part)
        self.joined.make_automaton()
        self.by_shape: dict[tuple[str, int], list[str]] = {}
        for t in dict.fromkeys([*plain, *sorted(w for w in self.words if len(w) > 3)]):
            self.by_shape.setdefault((t[0], len(t)), []).append(t)
        self.words_by_shape: dict[tuple[str, int], list[str]] = {}
        for t in sorted(self.words, key=lambda w: (-self.strength(f" {w} "), w)):
            self.words_by_shape.setdefault((t[0], len(t)), []).append(t)
        self.neighbours = {pair for t in plain for pair in zip(t.split(), t.split()[1:])}

    def _fill(self) -> None:
        for phrase in spelled_out(X.EXCEPTIONS):
            self._add(phrase, "shield", "")
        for phrase in spelled_out(X.HINTS):
            self._add(phrase, "hint", "")
        for phrase in spelled_out(X.NEARLY):
            self._add(phrase, "nearly", "")
        for languages in X.PATTERNS.values():
            for lang, patterns in languages.items():
                for phrase in spelled_out(patterns):
                    self._add(phrase, "idiom", lang)
        roles = ("insult", X.INSULTS), ("ambiguous", X.AMBIGUOUS), ("slur", X.SLURS), ("wretch", X.WRETCHES), ("contempt", X.CONTEMPT), ("subhuman", X.SUBHUMAN), ("vermin", X.VERMIN), ("lewd", X.LEWD), ("sex", X.SEX_VERBS), ("explicit", X.EXPLICIT), ("bare", X.BARE), ("desired", X.DESIRED), ("violence", X.VIOLENCE), ("violence_too", X.VIOLENCE_TOO), ("harm", X.HARM), ("driven", X.DRIVEN)
        for role, languages in roles:
            for lang, words in languages.items():
                for w in words.split():
                    self._add(w.replace("-", " "), role, lang)
                    if role in ("insult", "ambiguous"):
                        for plural in PLURALS:
                            self._add(w + plural, role, lang)
        for turn in self.learnt.turns:
            self.roles[f" {turn} "].add(("learnt", ""))

    def _add(self, phrase: str, role: str, lang: str) -> None:
        p = words_only(base_letters(phrase.strip()))
        if p.strip():
            self.roles[p].add((role, lang))

    def strength(self, term: str) -> float:
        """How much a term alone says; shields nothing."""
        alone = {"violence": 1.5, "violence_too": 0.3, "harm": 0.3, "wretch": 1.0, "vermin": 3.0, "driven": 0.5, "shield": 0.0, "lewd": 6.0, "sex": 6.0, "desired": 0.2, "learnt": 0.1}
        return max((alone.get(r, self.weights.get(r, 0.0)) for r, _ in self.roles.get(term, ())), default=0.0)

    # --- disguises ---------------------------------------------------------------------------------------------------------

    def _split(self, letters: str) -> str | None:
        """Letters as the fewest known words that they consist of."""
        best: list[tuple[int, int] | None] = [(0, 0), *[None] * len(letters)]  # words so far, start of the last one
        for end in range(1, len(letters) + 1):
            for start in range(max(0, end - self.longest), end):
                if best[start] and letters[start:end] in self.words and (best[end] is None or best[start][0] + 1 < best[end][0]):
                    best[end] = (best[start][0] + 1, start)
        if best[-1] is None:
            return None
        out, end = [], len(letters)
        while end:
            out.append(letters[best[end][1] : end])
            end = best[end][1]
        return " ".join(reversed(out))

    def _apart(self, m: re.Match) -> str:
        run = re.sub(r"[^a-z0-9]", "", m[0])
        for letters in (run, *(run.translate(t) for t in _LEET)):
            if words := self._split(letters):
                return words
            best: tuple[int, int, str] | None = None
            for end, term in self.joined.iter(letters):
                n = len(term.replace(" ", ""))
                if best is None or n > best[0]:
                    best = (n, end - n + 1, term)
            if best:
                n, at, term = best
                rest = letters[at + n :]
                return f"{letters[:at]} {term}{'' if rest in PLURALS else ' '}{rest}"
        return m[0]

    def _masked(self, m: re.Match) -> str:
        pattern = None
        # beside its neighbour in a term first, unless it is a strong word by itself
        before = _LAST_WORD.search(m.string, max(0, m.start() - self.longest - 8), m.start())
        for t in self.words_by_shape.get((m[0][0], len(m[0])), ()):
            pattern = pattern or re.compile(m[0].replace("*", "."))
            if pattern.fullmatch(t) and (self.strength(f" {t} ") >= WEIGHTS["ambiguous"] or before and (before[1], t) in self.neighbours):
                return t
        for t in self.by_shape.get((m[0][0], len(m[0])), ()):
            pattern = pattern or re.compile(m[0].replace("*", "."))
            if pattern.fullmatch(t):
                return t
        # a plural or ending behind a mask
        for cut in (1, 2):
            for t in self.by_shape.get((m[0][0], len(m[0]) - cut), ()):
                if re.fullmatch(m[0][:-cut].replace("*", "."), t):
                    return t + m[0][-cut:]
        return m[0]

    def _known(self, w: str) -> bool:
        return w in self.words or _LONG.sub(r"\1", w) in self.words or (w.endswith("s") and w[:-1] in self.words)

    def _signed(self, m: re.Match) -> str:
        """Signs that stand for letters; where they give no known word they are left as they are."""
        return next((w for table in _SIGNS if self._known(w := m[0].translate(table))), m[0])

    def _digits(self, m: re.Match) -> str:
        if m[0].isdigit():
            return m[0]
        return next((w for table in _LEET if self._known(w := m[0].translate(table))), m[0])

    def _number(self, m: re.Match) -> str:
        """A number behind ``your``, where it spells a word."""
        w = m[2].translate(_LEET[0])
        return f"{m[1]}{w}" if w in self.words and self.strength(f" {w} ") >= WEIGHTS["ambiguous"] else m[0]

    def _shortened(self, t: str) -> str:
        """Letters repeated three times and more are written once or twice, whichever gives a known word."""
        out, at = [], 0
        for m in _LONG.finditer(t):
            if m.start() < at:
                continue
            start = m.start()
            while start > at and "a" <= t[start - 1] <= "z":
                start -= 1
            end = _LETTERS.match(t, m.end()).end()
            once, twice = _LONG.sub(r"\1", t[start:end]), _LONG.sub(r"\1\1", t[start:end])
            out += [t[at:start], twice if twice in self.words else once]
            at = end
        return "".join([*out, t[at:]])

    def folded(self, text: str) -> str:
        """The text as plain words, disguises undone where they hide a term."""
        t = base_letters(text)
        t = _QUOTE.sub("", t)
        t = _APART.sub(self._apart, t)
        t = _BLANKS.sub(" ", t)
        if "*" in t:
            t = _MASKED.sub(self._masked, t)
        t = _SIGNED.sub(self._signed, _ELIDED.sub(r"\1 ", t))
        t = _PARTED.sub("", t)
        t = self._shortened(t)
        t = _DIGITS.sub(self._digits, t)
        t = f" {_OTHER.sub(' ', t).strip()} "
        return _NUMBER.sub(self._number, t)

    # --- what a word with a role is worth beside its neighbours -------------------------------------------------------------

    def _said_to(self, left: list[str], lang: str) -> tuple[bool, bool]:
        """(said to the reader, with contempt): ``you`` before, and nothing but words of degree and contempt between."""
        contempt = False
        for w in reversed(left):
            if w in YOU[lang]:
                return True, contempt
            if w in CONTEMPT[lang] or w in X.NASTY:
                contempt = True
            elif w not in BETWEEN[lang]:
                return False, contempt
        return False, contempt

    def _is_group(self, w: str, before: str | None, lang: str) -> bool:
        return w in GROUPS[lang] or w in self.group_names or (len(w) >= 6 and before in ARTICLES and w.endswith(X.PEOPLE_ENDINGS))

    def _said_of(self, left: list[str], lang: str) -> tuple[str | None, str | None]:
        """(who, how he is named) of ``who are <word>``: ``group`` by a name, ``people`` by an ending, ``they``, ``you``."""
        for i in range(len(left) - 1, max(-1, len(left) - 6), -1):
            w = left[i]
            if w in ARE[lang]:
                for k in range(i - 1, max(-1, i - 5), -1):
                    if left[k] in GROUPS[lang] or left[k] in self.group_names:
                        return "group", left[k]
                    if left[k] in YOU[lang]:
                        return "you", left[k]
                    if self._is_group(left[k], left[k - 1] if k else None, lang):
                        return "people", left[k]
                    if left[k] in THEY:
                        return "they", left[k]
                if w in BETWEEN[lang]:
                    continue
                return None, None
            if w not in BETWEEN[lang] and w not in CONTEMPT[lang] and w not in ("all", "alle", "tous", "todos", "allemaal", "doch", "pura", "la", "l"):
                return None, None
        return None, None

    @staticmethod
    def _own(left: list[str], right: list[str], lang: str) -> bool:
        if left and left[-1] in OWN_BESIDE:
            return True
        if any(w in YOU.get(lang, ()) for w in left[-5:]):
            return False
        before, after = f" {' '.join(left[-5:])} ", f" {' '.join(right[:4])} "
        return any(o in before for o in OWN if " " in o.strip()) or any(after.startswith(o) for o in OWN_AFTER)

    def _threatens(self, left: list[str], lang: str, reach: int = 6) -> bool:
        """Someone is to do it: ``I will``, ``somebody should``; not ``you will`` and not ``I will not``."""
        after = ""
        for w in reversed(left[-reach:]):
            if w in SOMEBODY[lang]:
                return True
            if w in NOT or (w in YOU[lang] and lang == "en" and after not in ("and", "or", "then")):
                return False
            after = w
        return False

    def _kinds(self, role: str, lang: str, term: str, left: list[str], right: list[str]) -> str | None:
        """The kind of find a word with a role is in this place, null for none."""
        if role in ("idiom", "nearly", "hint", "learnt"):
            return role
        base = next((term[: -len(p)] for p in PLURALS if term.endswith(p) and term[: -len(p)] in X.SENSES), term)
        around = (*left[-NEAR_WORDS:], *right[:NEAR_WORDS])
        if base in X.SENSES and any(w in X.SENSES[base].split() for w in around):
            return None
        mentioned = any(w in X.MENTION for w in around)
        first = right[0] if right else ""
        if role in ("insult", "ambiguous", "slur", "wretch"):
            said, contempt = self._said_to(left, lang)
            if role == "wretch":
                return "wretch_at" if said and (contempt or term not in X.PLAIN) else None
            if role != "slur" and (said or contempt or (left and left[-1] in X.HAIL) or first in YOU[lang] and first not in YOURS[lang]):
                return f"{role}_at"
            return None if mentioned or self._own(left, right, lang) else role
        if role == "contempt":
            said, _ = self._said_to(left, lang)
            if term in ("fucking", "goddamn", "shitty"):
                return "contempt_at" if said else "profanity"
            who, _ = self._said_of(left, lang)
            if who == "group":
                return "group_contempt"
            if right[:2] in (["as", "you"], ["like", "you"]) or right[:1] in (["wie"], ["als"], ["que"], ["comme"]) and right[1:2] in (["du"], ["tu"], ["toi"]):
                return "contempt_at"
            return "contempt_at" if said else None if mentioned or self._own(left, right, lang) else "contempt"
        if role in ("subhuman", "vermin"):
            who, _ = self._said_of(left, lang)
            if who == "group" or who == "people" and term not in X.THINGS:
                return "subhuman_is" if role == "subhuman" else "vermin_is"
            if who == "they":
                return "subhuman_is" if role == "subhuman" else "vermin_they"
            return "subhuman" if role == "subhuman" and not mentioned else None
        if role == "driven":
            be = left[-5:]
            if not any(w in ("be", "being") for w in be[-3:]) or not any(w in _MUST for w in be):
                return None
            before = left[-9:]
            return "driven" if any(w in THEY or self._is_group(w, before[i - 1] if i else None, lang) or w in ("them", "kind") for i, w in enumerate(before)) else None
        if role in ("violence", "violence_too"):
            if lang == "en":
                at_you = first in ("you", "u", "ya") and (role == "violence" or (right[1] if len(right) > 1 else "") not in X.KINDLY)
                at_kin = first in YOURS["en"] and len(right) > 1 and right[1] in KIN
                return "violence_you" if (at_you or at_kin) and self._threatens(left[-5:], lang) else None
            near = (*left[-3:], *right[:1]) if lang != "fr" else left[-1:]
            you = any(w in YOU[lang] for w in near) or lang == "es" and term.endswith("te")
            return "violence_you" if you and self._threatens(left, lang) and not any(w in NOT for w in (*left[-4:], *right[:2])) else None
        if role == "harm":
            for i, w in enumerate(right[:5]):
                if w in YOURS["en"]:
                    body = any(x in BODY["en"] for x in right[i + 1 : i + 3]) or any(x in ("bone", "bones", "finger") for x in right[:i])
                    return "harm_body" if body and self._threatens(left, "en") else None
                if w in YOU["en"]:
                    return None
            if first in ("every", "all", "each") and any(w in BODY["en"] for w in right[:3]) and any(w in YOU["en"] for w in right[:6]):
                return "harm_body" if self._threatens(left, "en") else None
            return None
        if role == "lewd":
            close = left[-3:]
            if close and any(w in YOURS[lang] for w in close) and self._said_to_yours(close, lang):
                return "lewd_yours"
            if term in ("ass", "butt", "bum", "dick", "po", "hintern", "cul", "bite", "culo", "reet", "cono", "pik", "cuisses", "pechos", "borsten", "bruste", "billen", "seins", "polla"):
                return None if mentioned else "bare"
            return "lewd_others" if close and close[-1] in OTHERS[lang] else None if mentioned else "lewd"
        if role == "sex":
            object_ = any(w in YOU[lang] or w in ("her", "him", "me", "tonight") for w in (*right[:2], *left[-2:])) or lang == "es" and term.endswith("te")
            wants = any(w in WANT[lang] or w in SOMEBODY[lang] for w in left[-5:]) and not any(w in NOT for w in left[-4:])
            if object_ and wants and not (term in ("screw", "bang", "mount", "ride", "suck", "lecken", "ausziehen", "blasen", "sauter") and "you" not in right[:1] and "dich" not in left[-3:] and "te" not in left[-1:]):
                return "sex_you"
            return "sex" if term in ("fuck", "shag", "grope", "ficken", "niquer", "enculer", "follar", "neuken", "baiser") and not mentioned else None
        if role == "desired":
            yours = any(w in YOURS[lang] for w in left[-2:])
            return "lewd_yours" if yours and any(w in X.DESIRE for w in (*left[-6:], *right[:5])) else None
        if role == "explicit":
            return None if mentioned else role
        if role == "bare":
            return "bare_you" if any(w in YOU[lang] or w in ("me", "her", "mir", "moi", "mij") for w in (*left[-2:], *right[:2])) else "bare"
        return None

    @staticmethod
    def _said_to_yours(close: list[str], lang: str) -> bool:
        for w in reversed(close):
            if w in YOURS[lang]:
                return True
            if w not in BETWEEN[lang] and w not in CONTEMPT[lang]:
                return False
        return False

    def finds(self, text: str) -> tuple[list[tuple[str, str]], int]:
        """((kind, term) of every find, each once; number of words).  Of finds that overlap the heavier counts."""
        t = self.folded(text)
        shields, hits = [], []
        for end, (n, roles) in self.auto.iter(t):
            start = end - n + 1
            if ("shield", "") in roles:
                shields.append((start + 1, end))
            left = right = None
            for role, lang in roles:
                if role == "shield":
                    continue
                if left is None:
                    left, right = t[max(0, start - NEAR_CHARS) : start].split(), t[end : end + NEAR_CHARS].split()
                if kind := self._kinds(role, lang, t[start + 1 : end], left, right):
                    hits.append((-self.weights[kind], start + 1, end, kind))
        found: dict[tuple[str, str], None] = {}
        if hits:
            taken = bytearray(len(t))
            for a, b in shields:
                taken[a:b] = b"\x01" * (b - a)
            for _, a, b, kind in sorted(hits):
                if not any(taken[a:b]):
                    found[kind, t[a:b]] = None
                    if kind != "learnt":
                        taken[a:b] = b"\x01" * (b - a)
        return list(found), t.count(" ") - 1

    def score(self, text: str) -> tuple[float, str | None]:
        """(weight of all finds, normalised by length; the strongest term)."""
        found, words = self.finds(text)
        if not found:
            return 0.0, None
        return self.evidence(found) / (1.0 + log10(1.0 + words / 1000.0)), max(found, key=lambda f: (self.weights[f[0]], f[1]))[1]

    def evidence(self, found: Iterable[tuple[str, str]]) -> float:
        learnt = sum(self.weights[k] for k, _ in found if k == "learnt")
        return sum(self.weights[k] for k, _ in found if k != "learnt") + min(LEARNT_MOST, learnt)


_MUST = frozenset(X.MUST["en"].split())
_NUMBER = re.compile(rf"( (?:{'|'.join(sorted(EVERY_YOURS))}) )([0-9]{{3,}})(?= )")


# --- judged examples --------------------------------------------------------------------------------------------------------


def learn(examples: list[tuple[str | None, str | None, str | None, int | None]], strength: float = 4.0) -> Learnt:
    """What (snippet, language, category, abusive) examples add.  Rows without snippet or verdict are left out.

    Turns: word triples that at least two different abusive examples and no harmless one have.  Groups: words of hateful
    examples in two languages that no other example has.  Weights: a logistic model of the kinds of finds whose prior are
    ``WEIGHTS`` (the greater ``strength``, the more examples it takes to move them), with ``THRESHOLD`` as its border.
    """
    rows = sorted({(s, g or "", c or "", int(a)) for s, g, c, a in examples if s and a is not None})
    plain = Lexicon()
    texts = [(plain.folded(s).split(), g, c, a) for s, g, c, a in rows]
    triples, lone = Counter(), Counter()
    languages: dict[str, set[str]] = defaultdict(set)
    elsewhere: set[str] = set()
    harmless: set[str] = set()
    for words, lang, category, abusive in texts:
        turns = {" ".join(w) for w in zip(words, words[1:], words[2:]) if not any(any(x.isdigit() for x in v) for v in w)}
        (triples.update(turns) if abusive else harmless.update(turns))
        for w in set(words):
            if abusive and category == "hate":
                languages[w].add(lang)
                lone[w] += 1
            else:
                elsewhere.add(w)
    out = Learnt(turns=sorted(t for t, n in triples.items() if n >= 2 and t not in harmless), groups=sorted(w for w, g in languages.items() if len(g) > 1 and lone[w] > 2 and w not in elsewhere and f" {w} " not in plain.roles and len(w) > 3))
    lex, kinds = Lexicon(out), list(WEIGHTS)
    prior = np.array([WEIGHTS[k] for k in kinds])
    if rows:
        x = np.array([[sum(k == f for f, _ in found) for k in kinds] for found in (lex.finds(s)[0] for s, *_ in rows)], dtype=float)
        x = np.minimum(x, 3.0)
        y, w = np.array([a for *_, a in rows], dtype=float), prior.copy()
        for _ in range(30):
            p = 1.0 / (1.0 + np.exp(-np.clip(x @ w - THRESHOLD, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(kinds)), x.T @ (p - y) + strength * (w - prior))
            w = w - step
            if np.abs(step).max() < 1e-9:
                break
        out.weights = {k: float(max(0.0, v)) for k, v in zip(kinds, w)}
    return out


def learn_from(labels: DataFrame, max_labels: int = 10_000) -> Learnt:
    """The same from a table (snippet, lang, category, abusive): of more than ``max_labels`` rows those that come first by a hash
    of the snippet."""
    rows = labels.where("snippet is not null and abusive is not null").orderBy(F.xxhash64("snippet"), "snippet", "lang", "category", "abusive").limit(max_labels)
    return learn([tuple(r) for r in rows.select("snippet", "lang", "category", "abusive").collect()])


_LEXICONS: dict[tuple, Lexicon] = {}


def lexicon(learnt: Learnt | None = None) -> Lexicon:
    """The worker's lexicon, built once for what was learnt."""
    key = (tuple(learnt.turns), tuple(learnt.groups), tuple(learnt.weights.values())) if learnt else ()
    if key not in _LEXICONS:
        _LEXICONS.clear()
        _LEXICONS[key] = Lexicon(learnt)
    return _LEXICONS[key]


def score_documents(documents: DataFrame, labels: DataFrame | None = None, max_labels: int = 10_000) -> DataFrame:
    """(doc_id, source, score, term, abusive) for every document; ``term`` is the strongest term found.

    The score covers subject and every text part, decoded once.  Null and empty texts score 0; a text is abusive if its
    score reaches ``THRESHOLD``.  ``labels`` are judged examples (snippet, lang, category, abusive), of which at most
    ``max_labels`` are learnt from; without them the general lexicon is used as it is.
    """
    learnt = learn_from(labels, max_labels) if labels is not None else None
    shared = documents.sparkSession.sparkContext.broadcast(learnt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = lexicon(shared.value)
        for pdf in batches:
            got = [lex.score(readable(t)) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "score": [g[0] for g in got], "term": [g[1] for g in got]})

    schema = f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, source string, score double, term string"
    scored = documents.select("doc_id", "source", "text").mapInPandas(run, schema)
    return scored.withColumn("abusive", F.col("score") >= THRESHOLD)


def rates(scored: DataFrame) -> DataFrame:
    """Documents, abusive ones and their rate per source."""
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.count_if("abusive").alias("n_abusive"), F.avg(F.col("abusive").cast("double")).alias("rate"), F.max("score").alias("top_score"))
