"""Quality rules, line first: failing lines go, then documents that lose too much text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOL = re.compile(r"[#*$%&|<>]")
SHOUT = re.compile(r"!{2,}|\?{2,}")
#: Terms of menus and of page furniture in English, French, German and Spanish, lower case.
NAVIGATION_TERMS = (
    "home", "about us", "contact us", "log in", "login", "sign in", "sign up", "privacy policy", "terms of use", "terms of service", "terms and conditions", "sitemap", "site map",
    "skip to content", "skip to main content", "next page", "previous page", "back to top", "read more", "share this",
    "accueil", "à propos", "nous contacter", "se connecter", "connexion", "mentions légales", "plan du site", "politique de confidentialité", "page suivante", "page précédente", "haut de page", "lire la suite",
    "startseite", "über uns", "kontakt", "anmelden", "impressum", "datenschutz", "datenschutzerklärung", "nächste seite", "vorherige seite", "nach oben", "weiterlesen", "zum inhalt",
    "inicio", "sobre nosotros", "contacto", "iniciar sesión", "aviso legal", "mapa del sitio", "política de privacidad", "página siguiente", "página anterior", "volver arriba", "leer más",
)
BOILERPLATE_TERMS = (
    "all rights reserved", "cookie policy", "cookies policy", "cookie settings", "cookies to improve", "enable javascript", "javascript is required", "javascript is disabled", "lorem ipsum", "subscribe to our", "click here", "powered by",
    "tous droits réservés", "gérer les cookies", "activer javascript", "abonnez-vous", "cliquez ici", "propulsé par",
    "alle rechte vorbehalten", "cookie-einstellungen", "javascript aktivieren", "newsletter abonnieren", "hier klicken", "bereitgestellt von",
    "todos los derechos reservados", "política de cookies", "activar javascript", "suscríbete a", "haga clic aquí", "desarrollado por",
)


def terms(words: tuple[str, ...]) -> re.Pattern:
    """Any of the terms as whole words, a blank in them any run of blanks."""
    return re.compile(r"(?<!\w)(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in sorted(words, key=len, reverse=True)) + r")(?!\w)", re.I)


NAVIGATION, BOILERPLATE = terms(NAVIGATION_TERMS), terms(BOILERPLATE_TERMS)
#: The end of a sentence: a terminal mark, closing quotes and brackets after it, then a blank or the end.
SENTENCE_END = re.compile(r"""[.!?…:;。！？؟।]["'»”’)\]]*(?:[\x20\x09-\x0D]|$)""")


@dataclass(frozen=True)
class LineRules:
    """Limits; the defaults are the production ones."""

    symbol_share: float = 0.10  # symbols per word of a line
    separator_share: float = 0.25  # words that are separators only, such as |
    shout_share: float = 0.30  # words that end in !! or ??
    repeat_share: float = 0.50  # words of a line that repeat the word before
    navigation_words: int = 12  # a line of navigation terms has fewer words
    lost_text: float = 0.40  # share of the words that removed lines may hold
    min_words: int = 50
    repeat_percent: int = 50


def line_fails(words: list[str], line: str, rules: LineRules) -> str:
    """The first rule that a line with words fails, or an empty string."""
    n = len(words)
    if SYMBOL.search(line):
        if sum(1 for w in words if not any(map(str.isalnum, w))) > rules.separator_share * n:
            return "separators"
        if len(SYMBOL.findall(line)) > rules.symbol_share * n and len(SYMBOL.findall(line)) > 2:
            return "symbols"
    if ("!!" in line or "??" in line) and sum(1 for w in words if SHOUT.search(w)) > rules.shout_share * n:
        return "shouting"
    if n >= 4 and sum(1 for a, b in zip(words, words[1:]) if a == b) > rules.repeat_share * n:
        return "stutter"
    if n < rules.navigation_words and NAVIGATION.search(line):
        return "navigation"
    if n < 2 * rules.navigation_words and BOILERPLATE.search(line):
        return "boilerplate"
    # a title, a menu entry or a cut line: not one sentence ends in it
    return "unfinished" if not SENTENCE_END.search(line) else ""


def repeated_words(words: list[str]) -> int:
    """Words that stand in a 3-word window which the text has twice or more, the first ones included."""
    windows = list(zip(words, words[1:], words[2:]))
    counts = Counter(windows)
    if len(counts) == len(windows):
        return 0
    covered, total = 0, 0  # words up to `covered` are counted
    for i, window in enumerate(windows):
        if counts[window] > 1:
            total += i + 3 - max(i, covered)
            covered = i + 3
    return total


def judge(text: str, rules: LineRules = LineRules()) -> dict:
    lines = text.split("\n")
    words: list[str] = []
    seen: set[str] = set()
    twice = lost = dropped = 0
    clean, why = [], Counter()
    for line in lines:
        own = WORD.findall(line)
        words += own
        failed = ""
        if own:
            twice += line in seen
            seen.add(line)
            failed = line_fails(own, line, rules)
        if failed:
            lost += len(own)
            dropped += 1
            why[failed] += 1
        else:
            clean.append(line)
    n, repeats = len(words), repeated_words(words)
    base_failed = n < rules.min_words or 100 * repeats > rules.repeat_percent * n
    return {
        "n_words": n, "word_chars": sum(map(len, words)), "n_symbols": len(SYMBOL.findall(text)), "n_dup_lines": twice, "n_repeat_words": repeats,
        "base_failed": base_failed, "kept": not base_failed and lost <= rules.lost_text * n,
        "lines_dropped": dropped, "words_lost": lost, "reason": max(sorted(why), key=why.get, default=""), "cleaned": "\n".join(clean),
    }


FIELDS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "lines_dropped": "long", "words_lost": "long", "reason": "string", "cleaned": "string"}
ARROW = {"long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: LineRules = LineRules(), with_text: bool = True) -> DataFrame:
    """id and the ``FIELDS`` for every whole text; ``cleaned`` (the text without failing lines) if ``with_text``.

    A line fails for separators, symbols, shouting, stutter, terms of navigation or boilerplate in four languages, or for
    having no sentence end.  A text is kept if it passes the base and its failing lines hold at most ``lost_text`` of its words.

    Words are runs of other characters than ASCII white space, lines are split at line feeds;
    a word that spans a carriage return or form feed does not exist, as those are white space.
    Null text counts as empty and has no words, so it fails the base.  Rows are independent: repeated rows
    give equal results, empty tables empty ones; ids may be null; extra columns are ignored.
    """
    names = [n for n in FIELDS if with_text or n != "cleaned"]

    def run(batches):
        for batch in batches:
            found = [judge(t.as_py() or "", rules) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[n] for f in found], ARROW[FIELDS[n]]) for n in names)], names=["id", *names])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return in_batches(rows, run, f"id {kind}, " + ", ".join(f"{n} {FIELDS[n]}" for n in names)).withColumnRenamed("id", id_col)
