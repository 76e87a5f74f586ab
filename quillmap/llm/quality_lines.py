"""Quality rules, line first: punctuation, navigation and boilerplate rules judge every line,
failing lines go, and a document that loses too much of its text is rejected.

Defined results: a null text counts as empty; an empty text has no words and is rejected by the
base rule on word counts; repeated rows and ids are judged row by row; an empty table gives an
empty table; other columns of the input are ignored (`judge`) or kept as they are (`clean`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import id_and_text, ship, text_slices, to_batch


@dataclass(frozen=True)
class LineRules:
    """Parameters. A line is kept if it fails no rule."""

    min_words: int = 20  #: base rule: documents with fewer words fail
    max_repeat_percent: int = 30  #: base rule: percent of words in repeated windows
    window: int = 8
    mark_share: float = 0.25  #: share of a line's words that carry symbols or end in "!!"
    short_words: int = 4  #: a line without end mark and with fewer words fails
    link_bars: int = 3  #: separators that make a line a menu or a table row
    max_lost: float = 0.5  #: a document that loses more than this share of its words is rejected


_END = re.compile(rb"(?:[.!?:;,\"')\]}]|\xe2\x80[\xa6\x9d\x99]|\xc2\xbb|\xe3\x80\x82)$")
_MARK = re.compile(rb"[#*$%&|<>]{2,}|[#$%&]$|!!$")
_ANY_MARK = re.compile(rb"[#*$%&|<>]|!!")
_BAR = re.compile(rb"(?:^|\s)(?:\||\xc2\xbb|\xe2\x80\xba|\xc2\xb7|\xe2\x80\xa2)(?=\s|$)")
# Beginnings of menu entries and phrases of page furniture, lower case, by language.
NAVIGATION = {
    "en": ("home", "menu", "next", "previous", "back to top", "skip to content", "skip to main content", "login", "log in", "sign in", "sign up", "subscribe", "share", "tweet", "print", "search", "read more", "contact us", "about us", "site map", "sitemap"),
    "de": ("startseite", "menü", "weiter", "zurück", "nach oben", "zum inhalt", "anmelden", "registrieren", "abonnieren", "teilen", "drucken", "suche", "mehr lesen", "weiterlesen", "kontakt", "über uns"),
    "fr": ("accueil", "suivant", "précédent", "haut de page", "aller au contenu", "connexion", "se connecter", "s'inscrire", "s'abonner", "partager", "imprimer", "rechercher", "lire la suite", "contactez-nous", "à propos", "plan du site"),
    "es": ("inicio", "menú", "siguiente", "anterior", "volver arriba", "saltar al contenido", "iniciar sesión", "registrarse", "suscribirse", "compartir", "imprimir", "buscar", "leer más", "contacto", "acerca de", "mapa del sitio"),
}
BOILERPLATE = {
    "en": ("all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "enable javascript", "powered by"),
    "de": ("alle rechte vorbehalten", "cookie-richtlinie", "datenschutzerklärung", "nutzungsbedingungen", "javascript aktivieren"),
    "fr": ("tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "activer javascript"),
    "es": ("todos los derechos reservados", "política de cookies", "política de privacidad", "términos de uso", "aviso legal", "activar javascript"),
}
LICENSE_STARTS = ("copyright", "licensed under", "released under", "this work is licensed under", "lizenziert unter", "sous licence", "bajo licencia")


def _any_of(phrases: dict[str, tuple[str, ...]]) -> str:
    return "|".join(re.escape(p).replace("\\ ", " ").replace("\\-", "-") for some in phrases.values() for p in some)


#: The same patterns for Python and, in the query's SQL, for RE2.
NAVIGATION_PATTERN = rf"^(?:{_any_of(NAVIGATION)})(?:$|[^\p{{L}}\p{{N}}])"
BOILERPLATE_PATTERN = rf"{_any_of(BOILERPLATE)}|^(?:{'|'.join(LICENSE_STARTS)})(?:$|[^\p{{L}}\p{{N}}])|© ?[0-9]{{4}}"
_NAVIGATION = re.compile(NAVIGATION_PATTERN.replace(r"[^\p{L}\p{N}]", r"[\W_]"))
_BOILERPLATE = re.compile(BOILERPLATE_PATTERN.replace(r"[^\p{L}\p{N}]", r"[\W_]"))


def line_verdict(line: bytes, rules: LineRules) -> str:
    """Name of the first rule that the line fails; empty if it stays. Lines without words stay."""
    words = line.split()
    if not words:
        return ""
    n = len(words)
    body = line.strip()
    bars = len(_BAR.findall(body))
    if bars >= rules.link_bars or (bars and 2 * bars + 2 >= n):
        return "navigation"
    if _ANY_MARK.search(body):
        if sum(1 for w in words if _MARK.search(w)) >= max(2, rules.mark_share * n):
            return "punctuation"
    if n < rules.short_words and not _END.search(body):
        return "punctuation"
    if n <= 12:
        low = body.decode("utf-8", "replace").lower()
        if n <= 6 and not _END.search(body) and _NAVIGATION.search(low):
            return "navigation"
        if _BOILERPLATE.search(low):
            return "boilerplate"
    return ""


def clean_text(text: bytes, rules: LineRules) -> tuple[bytes, int]:
    """(the text without failing lines, the words that went)."""
    kept, lost = [], 0
    for line in text.split(b"\n"):
        if line_verdict(line, rules):
            lost += len(line.split())
        else:
            kept.append(line)
    return (b"\n".join(kept), lost) if lost else (text, 0)


def _repeat_words(texts: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each text, words of each in windows found twice or more in it)."""
    words, bounds = K.words_of(texts)
    counts = np.diff(bounds)
    starts = K.whole_windows(bounds, size)
    if not len(starts):
        return counts, np.zeros(len(texts), np.int64)
    owner = K.owners(bounds)
    keys = K.mix(K.window_hashes(words, size)[starts] + K.mix(owner[starts].astype(np.uint64) + K.U(1)))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    again = np.zeros(len(keys), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    hit = K.covered(starts[again], size, len(words))
    return counts, np.bincount(owner[hit], minlength=len(texts))


def _judged(texts: list[bytes], rules: LineRules, want_text: bool) -> list[tuple]:
    """One row of values for each text of a slice."""
    out = []
    counts, repeats = _repeat_words(texts, rules.window)
    for text, n, repeat in zip(texts, counts.tolist(), repeats.tolist()):
        lines = [x for x in text.split(b"\n") if x.strip()]
        dense = text.translate(None, b" \t\n\r\x0b\x0c")
        symbols = len(dense) - len(dense.translate(None, b"#*$%&|<>"))
        chars = len(dense.decode("utf-8", "replace"))
        failed = n < rules.min_words or 100 * repeat > rules.max_repeat_percent * n
        cleaned, lost = clean_text(text, rules)
        kept = not failed and lost <= rules.max_lost * n
        row = (n, chars, symbols, len(lines) - len(set(lines)), repeat, failed, lost, kept)
        out.append((*row, cleaned.decode("utf-8", "replace")) if want_text else row)
    return out


_COLUMNS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("n_lost_words", pa.int64()), ("kept", pa.bool_())]
_DDL = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lost_words long, kept boolean"


def judge(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: word, symbol and repetition counts, the base rule, the words
    that failing lines hold, and whether the document stays. No shuffle: one pass of the scan."""
    ship(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), *_COLUMNS])

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                yield to_batch([part.column(0)], _judged(texts, rules, False), schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, f"doc_id long, {_DDL}")


def clean(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns and the text without its failing lines."""
    ship(docs.sparkSession)
    names, position = docs.columns, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch, position):
                rows = _judged(texts, rules, True)
                columns = list(part.columns)
                columns[position] = pa.array([r[8] for r in rows], pa.string())
                keep = pa.array([r[7] for r in rows], pa.bool_())
                yield pa.RecordBatch.from_arrays(columns, names=names).filter(keep)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, docs.schema)
