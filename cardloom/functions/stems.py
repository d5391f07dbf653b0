"""English stems of the Snowball project's second Porter algorithm, over a vocabulary."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words, special words and endings that the published algorithm and its word list name.
STOP = tuple("""i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself they them their theirs themselves
what which who whom this that these those am is are was were be been being have has had having do does did doing a an the and but if or because as until while of at by for with
about against between into through during before after above below to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don should now""".split())
STOPS = frozenset(STOP)
SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
AFTER_PLURAL = ("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed")
SECOND = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize", "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al",
    "alli": "al", "fulness": "ful", "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og", "fulli": "ful", "lessli": "less", "li": "",
}
THIRD = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion")
SHORT = r"(^[aeiouy][^aeiouy]$)|([^aeiouy][aeiouy][^aeiouywxY]$)"


#: A light English stem by endings, in order: plural, -ed and -ing; and the words that it leaves out.
LIGHT = ((r"ies$", r"i"), (r"(ss|sh|ch|x)es$", r"\1"), (r"([^su])s$", r"\1"), (r"^(.*[aeiouy].*)(ed|ing)$", r"\1"))
LIGHT_STOP = tuple("""a about after all also am an and any are as at be because been but by can did do does for from had has have he her here him his how i if in into is it its just me more most my no nor
not of on or our out so than that the their them then there these they this those to too up us was we were what when where which who why will with you your""".split())


def words(text: Column) -> Column:
    """The lower-case words of a text: runs of letters and digits of any script."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _endings(rules: Iterable[str]) -> re.Pattern:
    return re.compile(f"({'|'.join(sorted(rules, key=len, reverse=True))})$")


REGION, VOWEL, CLOSED = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]"), re.compile("[aeiouy]"), re.compile(SHORT)
PLURAL, PAST, LAST = _endings(("sses", "ied", "ies", "us", "ss", "s")), _endings(("eedly", "eed", "edly", "ed", "ingly", "ing")), _endings("el")
DOUBLE, LAST_Y = re.compile("(bb|dd|ff|gg|mm|nn|pp|rr|tt)$"), re.compile("(?<=.[^aeiouy])[yY]$")
DERIVED = ((_endings(SECOND), SECOND), (_endings(THIRD), THIRD), (_endings(FOURTH), dict.fromkeys(FOURTH, "")))


def porter2(word: str) -> str:
    """The stem of a lower-case word."""
    if word in SPECIAL or len(word) <= 2:
        return SPECIAL.get(word, word)
    w = re.sub("([aeiouy])y", r"\1Y", re.sub("^y", "Y", word))
    begun = re.match("gener|commun|arsen", w) or REGION.match(w)
    p1 = begun.end() if begun else len(w)
    again = REGION.match(w, p1)
    p2 = again.end() if again else len(w)
    if m := PLURAL.search(w):
        x, cut = m[0], w[: m.start()]
        w = f"{cut}ss" if x == "sses" else cut + ("i" if len(cut) > 1 else "ie") if x in ("ied", "ies") else cut if x == "s" and VOWEL.search(cut[:-1]) else w
    if w in AFTER_PLURAL:
        return w
    if m := PAST.search(w):
        x, cut = m[0], w[: m.start()]
        if x.startswith("eed"):
            w = f"{cut}ee" if len(cut) >= p1 else w
        elif VOWEL.search(cut):
            w = f"{cut}e" if cut.endswith(("at", "bl", "iz")) else cut[:-1] if DOUBLE.search(cut) else f"{cut}e" if p1 >= len(cut) and CLOSED.search(cut) else cut
    w = LAST_Y.sub("i", w)
    for step, (pattern, rules) in enumerate(DERIVED):
        if m := pattern.search(w):
            x, cut = m[0], w[: m.start()]
            fits = len(cut) >= (p2 if step == 2 or x == "ative" else p1)
            fits &= cut[-1:] in {"ogi": ("l",), "li": tuple("cdeghkmnrt"), "ion": ("s", "t")}.get(x, (cut[-1:],))
            w = cut + rules[x] if fits else w
    if m := LAST.search(w):
        cut = w[:-1]
        w = cut if len(cut) >= p2 and (m[0] == "e" or cut.endswith("l")) or m[0] == "e" and len(cut) >= p1 and not CLOSED.search(cut) else w
    return w.replace("Y", "y")


def stem(word: Column) -> Column:
    """The stem of a lower-case word; null for stop words and null.

    Meant for a vocabulary, where a word is stemmed once however often texts
    hold it; there, batches of words beat nested expressions by far.
    """

    @F.pandas_udf("string")
    def stems(words: pd.Series) -> pd.Series:
        return words.map(lambda w: None if w is None or w in STOPS else porter2(w))

    return stems(word)
