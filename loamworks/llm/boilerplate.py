"""Main body of web pages, by consensus of host paths (problem 2).

Texts of pages have no tags left, so a container is a line in its place and its path is the
line generalised: numbers become 0 and capitalised words X, but for sentences and for lines
made of capitalised words only, which are paths as they stand. Each page scores its lines
by general cues, by the page's own subject and by place: that score only seeds the vote.
In Spark, the pages of a host vote on each path. What a host's pages repeat is its frame,
what one page alone holds is its body, and what follows the headline is its byline, however
often it comes back. Hosts then vote on the paths that other hosts saw too rarely. The lines
are taken again by the winning paths: every line is decided by its path's vote.

`body_blocks` does the same for HTML, where containers are elements and paths are
their tags and classes.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamworks.llm.lookalike import canonical_batch, site_and_page, slices
from loamworks.llm.repeated_lines import split_lines
from loamworks.session import cut

VOTES = 3  # distinct pages from which on a host's repetition of a path is evidence
MIDDLE = 0.02  # share of the host's pages at which repetition of a path speaks neither way
MIDDLE_HEADING = 0.4  # the same for a few words between two lines of the body, which may be a subheading
MIDDLE_PROSE = 0.1  # the same for sentences, since texts are quoted and copied from page to page
SLOPE = 1.2  # weight of the logarithm of that share
COUNT = 0.5  # weight of the logarithm of the number of pages
MOST = 3.5  # what repetition can add at most
HEADING_WORDS = 6  # words of a subheading at most
RUN_LINES = 3  # short lines without the subject in a row that make a list of links or a menu
RARE = 0.4  # weight of the logarithm of a host's pages (over FEW) against paths that fewer than VOTES of them hold
FEW = 4.0
LONE = -0.5  # evidence on a path that fewer than VOTES pages hold: place alone is not enough
BYLINE = -5.0  # evidence of a path that always follows the headline; it grows with the square of how often it does
WEB_SHARE = 0.5  # weight of other hosts' votes where the host's pages have voted
WEB = 2.5  # what the votes of other hosts can add or take at most

SUBJECT, PROSE, AMID, BEFORE, AFTER, RUN, CRUMB, MENU_LINE = -4.5, -1.0, -1.5, 1.5, 0.5, 0.5, 7.0, 2.5  # seeds, see `page_lines`

# Usual entries of menus, one language to a line.
MENU = """
about|about us|account|basket|blog|careers|cart|community|contact|documentation|download|events|faq|forum|guides|help|help centre|home|imprint|investors|jobs|locations|log in|login|my account|news|partners|press|pricing|privacy|products|register|sale|search|services|shop|shop all|sign in|sign up|sitemap|status|store|support|team|terms|topics
accueil|actualités|agences|aide|à propos|boutique|compte|confidentialité|connexion|contact|emplois|équipe|mentions légales|panier|presse|produits|recherche|services|tarifs
acerca de|aviso legal|ayuda|buscar|cesta|contacto|cuenta|empleo|entrar|equipo|inicio|noticias|precios|prensa|privacidad|productos|sedes|servicios|tienda
agb|aktuelles|anmelden|datenschutz|dienste|hilfe|impressum|karriere|kontakt|konto|preise|presse|produkte|ratgeber|standorte|start|startseite|suche|team|über uns|warenkorb
"""
# General cues of boilerplate, phrases that may stand anywhere in a line. They only seed the vote.
CUES = """
cookie|cookies|consent|similar techniques|your choice|votre choix|vos choix|su elección|ihre wahl|socios|partenaires|kennungen|identifiers|identifiants|identificadores
all rights reserved|tous droits réservés|todos los derechos reservados|alle rechte vorbehalten
subscribe|unsubscribe|newsletter|sign up|log in|sign in|in your inbox|readers|abonnez-vous|connectez-vous|recevez|suscríbase|reciba|boletín|abonnieren|erhalten sie|anmelden|kommentieren|commenter|comentar|to comment
privacy policy|terms of use|terms of service|cookie settings|back to top|skip to content|haut de page|volver arriba|nach oben|zum inhalt|aller au contenu|ir al contenido
"""
# Phrases that are cues at the start of a line only.
CUES_AT_START = """
©|c|copyright|advertisement|sponsored|publicidad|publicité|werbung|anzeige|patrocinado|sponsorisé|gesponsert
share|like|follow|save|pin|repost|forward|rate|recommend|print|send|tell|accept|agree|reject|decline|allow|settings|manage|only necessary|ok|got it|no thanks
compartir|reenviar|recomendar|guardar|imprimir|acepto|aceptar|rechazar|configurar|partager|transmettre|conseiller|enregistrer|imprimer|accepter|refuser|paramétrer|teilen|weitersagen|empfehlen|merken|drucken|weiterleiten|zustimmen|ablehnen|einstellungen|einverstanden
related|recommended|you may also|most read|more from|more like|see also|read next|read more|learn more|también le|lo más|más de|más información|à lire|sur le même|plus de|en savoir plus|lesen sie auch|das könnte sie|mehr von|mehr zum|mehr erfahren|meistgelesen
"""
# Weaker phrases, of legal notices, prompts and teasers.
WEAK_CUES = """
liability|warranty|general information only|no contract|professional advice|financial advice|in writing|reproduction|reproduced|property of|registered trade name|own risk|without notice|company number|prices include|include tax|provisional|at any time|under the law|until the next notice|until further notice|may be changed|may be copied|may not be copied|cannot be copied
no garantiza|sin garantía|propiedad|contrato|permiso|derecho|derechos|provisionales|en cualquier momento|hasta nuevo aviso|sans garantie|propriété|contrat|droit|droits|provisoires|à tout moment|jusqu'à nouvel avis|ohne gewähr|unverbindlich|eigentum|vorbehalten|nachdruck|vertrag|jederzeit|bis auf widerruf|vorläufig
found this useful|people like this|personnes aiment|personas les gusta|gefällt|report an error|copy link|by mail|free of charge|do not miss|never miss
"""
WEAK_CUES_AT_START = "made in|hecho en|fabriqué à|hergestellt in|news from|new at|neues von|neues aus|novedades de|du neuf"
WEAK_CUES_AT_END = "im überblick|en bref|en breve|explained"
STRONG, WEAK = 2.0, 1.5
# How bylines and date lines begin or end, which belong to the body.
BYLINES = re.compile(r"(?:by|written by|text|words|par|por|von|published|publié|publicado|posted|updated|stand|redacción|rédaction|la rédaction|aus der redaktion)\b")
READING_TIME = ("min read", "minutes read")

_MENU = frozenset(x for line in MENU.strip().split("\n") for x in line.split("|"))
_PHRASES: dict[str, list[tuple[str, float]]] = {}  # by first word; a line is padded with marks of its start and end
for _block, _left, _right, _weight in ((CUES, " ", " ", STRONG), (CUES_AT_START, "^ ", " ", STRONG), (WEAK_CUES, " ", " ", WEAK), (WEAK_CUES_AT_START, "^ ", " ", WEAK), (WEAK_CUES_AT_END, " ", " $", WEAK)):
    for _phrase in _block.strip().replace("\n", "|").split("|"):
        _PHRASES.setdefault(_phrase.split()[0], []).append((_left + _phrase + _right, _weight))
_STARTS = frozenset(_PHRASES)
_SEPARATORS = re.compile(r"[|/>»›•·]| - |\s\s")
_SCHEME = re.compile(r"^\w+://(?:www\.)?")
_STOP = re.compile(r"(?<=[.!?])\s+")
_EDGE = re.compile(r"^[\s*•»·-]+|(?:\s*(?:\(\d+\)|[*!.»]))+\s*$")
_ENDED = re.compile(r"[.!?…][\"'»”]?(?:\s*(?:\(\d+\)|\*))*\s*$")
_LIST = re.compile(r"\s*[|/>»›•·]\s*|\s+-\s+|\s{2,}")
_NUMBER = re.compile(r"\d[\d ,.]*\d|\d")
_CAPITAL = re.compile(r"\b[^\W\d_a-zß-öø-ÿа-яёα-ω][\w'’]*(?:-[\w'’]+)*")
_SMALL = re.compile(r"\b[a-zß-öø-ÿа-яёα-ω][\w'’]+")


def line_key(line: str) -> str:
    """A line without marks and counts at its ends."""
    line = line.strip(" \t*•»·")
    return _EDGE.sub("", line).strip() if line and (line[-1] in ").!" or line[0] == "-") else line


def is_prose(line: str, key: str) -> bool:
    """Whether a line reads like sentences: twelve words or more with an end, or twenty, and no list of entries."""
    words = key.count(" ") + 1
    return words >= 12 and (words >= 20 or ". " in key or bool(_ENDED.search(line[-20:]))) and key.count(" | ") + key.count(" / ") < 2


def generalised(key: str) -> str:
    """A line with its numbers as 0 and its capitalised words as X; with one other word the first word stays; lines of none, and lists, keep their words."""
    masked = _NUMBER.sub("0", key.capitalize() if key.isupper() else key)
    if len(_LIST.split(key)) > 1:
        return masked.lower()
    general = _CAPITAL.sub("X", masked)
    small = len(_SMALL.findall(general))
    if small >= 2:
        return general
    first, _, rest = masked.partition(" ")
    return f"{first.lower()} {_CAPITAL.sub('X', rest)}" if small else masked.lower()


def _strongest(low: str) -> float:
    for sign in ".,;:!?()":
        if sign in low:
            low = low.replace(sign, " ")
    words = low.split()
    if _STARTS.isdisjoint(words):
        return 0.0
    padded = " ".join(["^", *words, "$"])
    return max((w for first in _STARTS.intersection(words) for phrase, w in _PHRASES[first] if phrase in padded), default=0.0)


def cue_weight(low: str) -> float:
    """Weight of the strongest cue; of long texts, only as far as sentences with cues make it up."""
    whole = _strongest(low)
    if len(low) < 160 or not whole:
        return whole
    return sum(len(s) * _strongest(s) for s in _STOP.split(low)) / len(low)


def _seed(key: str, prose: bool) -> tuple[float, str]:
    """Seed score of a line by itself, and its path."""
    low = key.lower()
    if low in _MENU:
        return MENU_LINE, low
    if _SEPARATORS.search(low):
        pieces = [p for p in _LIST.split(low) if p]
        if len(pieces) > 1 and sum(p in _MENU for p in pieces) * 2 >= len(pieces):
            return MENU_LINE, low
    if prose:
        return PROSE + cue_weight(low), low
    if BYLINES.match(low) or low.endswith(READING_TIME):
        return -2.0, generalised(key)
    return cue_weight(low), generalised(key)


_short_seed = functools.lru_cache(maxsize=200_000)(_seed)  # short lines come back


def page_subject(url: str) -> str:
    """The page's subject: the words of the last part of its path; none if the path names no page."""
    path = re.split(r"[?#]", _SCHEME.sub("", url))[0].rstrip("/")
    tail = re.sub(r"\.\w{2,5}$|[-_]?\d+$", "", path.rsplit("/", 1)[-1]).lower() if "/" in path else ""
    tail = re.sub(r"[-_+]+|%20", " ", tail).strip()
    return "" if len(tail) < 4 or tail in _MENU else tail


def page_lines(url: str, lines: list[str]) -> list[tuple[int, str, float, bool, bool, bool, bool]]:
    """Each line that is not blank: line_no, path, seed, and whether it follows the headline, is prose, stands between
    two lines of the body, and may be a subheading there.

    The headline is the first line that holds the page's subject and is no breadcrumb (entries that
    end with the subject). Seeds: the line's own, the subject (a body's), breadcrumbs, places before
    the headline and after the body's last line, runs of short lines, and a place between two lines of the body.
    """
    subject = page_subject(url)
    rows = []
    head = -1
    for k, line in enumerate(lines):
        key = line_key(line)
        if not key:
            if not line.strip():
                continue
            key = line.strip()
        prose = is_prose(line, key)
        if subject and not prose and subject in (low := key.lower()):
            pieces = [p for p in _LIST.split(low) if p]
            if len(pieces) > 1 and pieces[-1] == subject and max(map(len, pieces[:-1])) <= 30:
                rows.append([k, "> {subject}", CRUMB, False])
                continue
            at = low.find(subject)
            path, seed = generalised(key[:at] + "X" + key[at + len(subject) :]), SUBJECT
            if head < 0:
                head = len(rows)
        else:
            seed, path = (_seed if prose else _short_seed)(key, prose)
        rows.append([k, path, seed, prose])
    body = [i for i, r in enumerate(rows) if r[3] and r[2] < 0.3 or r[2] < -1.5]
    last = body[-1] if body else len(rows)
    inside = np.zeros(len(rows) + 1, bool)
    inside[body] = True
    after = [0 <= head < i <= head + 2 and not r[3] for i, r in enumerate(rows)]
    run = 0
    for i, r in enumerate([*rows, [0, "", 0.0, True]]):
        if i < len(rows) and not (r[3] or r[2] < -1.5 or after[i]):
            run += 1
            continue
        if run >= RUN_LINES:  # a container; a longer one with a cue in it says more
            more = 2 * RUN if run > RUN_LINES and max(rows[j][2] for j in range(i - run, i)) >= 1.5 else RUN
            for j in range(i - run, i):
                rows[j][2] += more
        run = 0
    for i, r in enumerate(rows):
        if r[1] != "> {subject}":
            r[2] += BEFORE * (i < head) + AFTER * (i > last)
    amid = [i > 0 and bool(inside[i - 1] and inside[i + 1]) for i in range(len(rows))]
    return [(k, path, seed, after[i], prose, amid[i], amid[i] and path.count(" ") < HEADING_WORDS) for i, (k, path, seed, prose) in enumerate(rows)]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


KNOWN = 300_000  # paths whose digests a worker keeps at once
VOTE_ROWS = "rec long, site long, page long, line_no int, path long, seed float, after boolean, prose boolean, amid boolean, heading boolean"


def _rows(b: pd.DataFrame, containers: list[list[tuple]], known: dict[str, int]) -> pd.DataFrame:
    """The containers of each text of a batch as rows, paths as digests, and a row without path for each text."""
    rec, flat = [], []
    for i, rows in enumerate(containers):
        rec += [i] * (len(rows) + 1)
        flat += [(-1, None, 0.0, False, False, False, False), *rows]
    no, path, seed, after, prose, amid, heading = zip(*flat) if flat else [()] * 7
    if len(known) > KNOWN:
        known.clear()
    for p in set(path) - known.keys() - {None}:
        known[p] = _digest(p)
    keys = b[["rec", "site", "page"]].iloc[np.array(rec, np.int64)].reset_index(drop=True)
    return keys.assign(
        line_no=np.array(no, np.int32), path=pd.array([None if p is None else known[p] for p in path], dtype="Int64"),
        seed=np.array(seed, np.float32), after=np.array(after, bool), prose=np.array(prose, bool), amid=np.array(amid, bool), heading=np.array(heading, bool),
    )


def _lines_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for b in (part for batch in batches for part in slices(batch, "text")):
        forms = canonical_batch(b["text"].tolist())[0]
        yield _rows(b, [page_lines(url, split_lines(form)) for url, form in zip(b["url"], forms)], known)


def _evidence(votes: int) -> Column:
    """A host's evidence on a path: its pages' mean seed and how many of them repeat it."""
    n, pages, after = F.col("n"), F.col("pages"), F.col("after")
    middle = F.when(F.col("prose"), F.lit(MIDDLE_PROSE)).when(F.col("heading") >= 0.5, F.lit(MIDDLE_HEADING)).otherwise(F.lit(MIDDLE))
    share = F.least(F.lit(MOST), F.greatest(F.lit(-MOST), SLOPE * F.log(n / pages / middle) + COUNT * F.log(n / votes)))
    rare = LONE + AMID * F.col("amid") - RARE * F.greatest(F.lit(0.0), F.log(pages / FEW))
    return F.col("own") + F.when(n < votes, rare).otherwise(share * (1 - after) + BYLINE * after * after)


def path_votes(rows: DataFrame, votes: int = VOTES) -> DataFrame:
    """site, path and its vote (above 0: boilerplate), with n, the pages that hold it, and own, their mean seed.

    `rows` are those of VOTE_ROWS; the one row without path stands for a page. Distinct pages are counted
    in two steps with sums before each shuffle, so a site with a third of all rows is spread over its paths
    and pages. Digests of paths have 64 bits and meet only within the 64 bits of their site's.
    """
    hosts = rows.filter("path IS NULL").select("site", "page").distinct().groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    mean = lambda c: F.avg(F.col(c).cast("float")).alias(c)
    by_page = rows.filter("path IS NOT NULL").groupBy("site", "path", "page").agg(mean("seed"), mean("after"), mean("amid"), mean("heading"), F.max("prose").alias("prose"))
    paths = by_page.groupBy("site", "path").agg(F.count(F.lit(1)).alias("n"), F.avg("seed").alias("own"), mean("after"), mean("amid"), mean("heading"), F.max("prose").alias("prose"))
    paths = paths.join(hosts, "site").select("site", "path", "n", "own", _evidence(votes).alias("host"))
    # hosts that saw a path often enough vote for those that did not
    sure = F.when(F.col("n") >= votes, F.col("host"))
    web = paths.groupBy("path").agg(F.sum((sure > 0).cast("int")).alias("won"), F.sum((sure <= 0).cast("int")).alias("lost")).filter("won + lost > 0")
    log = F.coalesce(F.log((F.col("won") + 0.5) / (F.col("lost") + 0.5)), F.lit(0.0))
    others = F.least(F.lit(WEB), F.greatest(F.lit(-WEB), log))
    weight = F.when(F.col("n") < votes, F.lit(1.0)).otherwise(F.lit(WEB_SHARE))
    return paths.join(web, "path", "left").select("site", "path", "n", "own", (F.col("host") + weight * others).alias("vote"))


def _base(pages: DataFrame, key: str, url: str, text: str) -> DataFrame:
    site, page = site_and_page(F.coalesce(F.col(url), F.lit("")))
    return pages.select(F.col(key).cast("long").alias("rec"), F.xxhash64(site).alias("site"), F.xxhash64(page).alias("page"), F.coalesce(F.col(url), F.lit("")).alias("url"), F.col(text).alias("text")).filter(F.length("text") > 0)


def boilerplate_lines(fetches: DataFrame, key: str = "result_id", url: str = "url", text: str = "raw_text", votes: int = VOTES) -> DataFrame:
    """key and line_no of each non-blank line outside the body of its page.

    Null and empty texts give no line; rows with a null url form one site with one page, where every line's
    own score and other hosts decide. Texts are read once and whole; lines of any length are treated alike.
    """
    rows = cut(_base(fetches, key, url, text).mapInPandas(_lines_of, VOTE_ROWS))  # used four times
    won = path_votes(rows, votes).filter("vote > 0").select("site", "path")
    return rows.filter("path IS NOT NULL").join(won, ["site", "path"], "left_semi").select(F.col("rec").alias(key), "line_no")


# ---- HTML: containers are elements, paths their tags and classes
_BLOCKS = frozenset("address article aside blockquote body dd div dl dt fieldset figcaption footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIPPED = frozenset("script style noscript template svg head".split())
# Seeds of elements by their meaning in HTML.
TAG_SEEDS = {"nav": 2.0, "footer": 2.0, "aside": 1.5, "form": 1.0, "main": -1.0, "article": -1.0}
LINKS = 1.5  # seed of a block most of whose signs stand in links
DEPTH = 6  # elements of a path, from the block outwards


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.skipped = self.links = 0
        self.out: list[list] = []  # path, pieces of text, signs in links

    def _break(self) -> None:
        self.out.append(["/".join(step for _, step in self.open if step)[-400:], [], 0])

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _VOID:
            if tag in ("br", "hr"):
                self._break()
            return
        classes = " ".join(v or "" for k, v in attrs if k == "class").lower().split()
        self.open.append((tag, ".".join([tag, *sorted(_NUMBER.sub("0", c) for c in classes)]) if tag in _BLOCKS else ""))
        self.skipped += tag in _SKIPPED
        self.links += tag == "a"
        if tag in _BLOCKS:
            self._break()

    def handle_endtag(self, tag: str) -> None:
        if tag not in [t for t, _ in self.open]:
            return
        while self.open:
            t, _ = self.open.pop()
            self.skipped -= t in _SKIPPED
            self.links -= t == "a"
            if t == tag:
                break
        if tag in _BLOCKS:
            self._break()

    def handle_data(self, data: str) -> None:
        if not self.skipped and data.strip():
            if not self.out:
                self._break()
            self.out[-1][1].append(data)
            self.out[-1][2] += len(data.strip()) * (self.links > 0)


def html_blocks(html: str) -> list[tuple[str, str, float]]:
    """Path of tags and classes, text and share of signs in links, of each block of text in a page's HTML."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    out = []
    for path, pieces, linked in parser.out:
        text = " ".join("".join(pieces).split())
        if text:
            out.append(("/".join(path.split("/")[-DEPTH:]), text, linked / len(text)))
    return out


def _blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    for b in (part for batch in batches for part in slices(batch, "text")):
        rows, boxes, texts = [], [], []
        for url, html in zip(b["url"], b["text"]):
            blocks = html_blocks(html)
            forms = canonical_batch([t.replace("\n", " ") for _, t, _ in blocks])[0]
            lines = page_lines(url, forms)
            seeds = [sum(TAG_SEEDS.get(step.split(".")[0], 0.0) for step in blocks[r[0]][0].split("/")) + LINKS * (blocks[r[0]][2] > 0.5) for r in lines]
            rows.append([(k, path, seed + more, *rest) for (k, path, seed, *rest), more in zip(lines, seeds)])
            boxes += [None, *(_digest(blocks[r[0]][0]) for r in lines)]
            texts += [None, *(blocks[r[0]][1] for r in lines)]
        yield _rows(b, rows, known).assign(box=pd.array(boxes, dtype="Int64"), block=pd.Series(texts, dtype=object))


def body_blocks(pages: DataFrame, key: str = "id", url: str = "url", html: str = "html", votes: int = VOTES) -> DataFrame:
    """key, block_no, text and boilerplate (whether it is outside the body) of each block of text of pages in HTML.

    The votes on blocks' texts, as for lines, are averaged over each path of tags and classes on a page and then
    over the host's pages: a path on `votes` or more pages is kept or dropped as a whole, others block by block.
    Null and empty pages give no block.
    """
    rows = cut(_base(pages, key, url, html).mapInPandas(_blocks_of, VOTE_ROWS + ", box long, block string"))
    voted = rows.filter("path IS NOT NULL").join(path_votes(rows, votes).select("site", "path", "vote"), ["site", "path"])
    bounded = F.least(F.lit(MOST), F.greatest(F.lit(-MOST), F.col("vote")))
    by_page = voted.groupBy("site", "box", "page").agg(F.avg(bounded).alias("v"))
    boxes = by_page.groupBy("site", "box").agg(F.avg("v").alias("box_vote"), F.count(F.lit(1)).alias("box_pages"))
    vote = F.when(F.col("box_pages") >= votes, F.col("box_vote")).otherwise(F.col("vote"))
    return voted.join(boxes, ["site", "box"]).select(F.col("rec").alias(key), F.col("line_no").alias("block_no"), F.col("block").alias("text"), (vote > 0).alias("boilerplate"))
