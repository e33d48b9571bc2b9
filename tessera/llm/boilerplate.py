"""Page boilerplate mixed with main content: which lines of a web page are not its main body.

Two passes over the lines of a page.  The first decides the clear ones from stop-word density, length, link
density, markup and cue words: sentences, lists, tables, quotations, code and marked headings are good;
link lists, menus, notices and sharing or footer lines are bad.  The line that repeats the page's own
title opens the main body; what stands before it is bad.  In the second pass short undecided lines inherit
the label of their nearest decided neighbours: a line that heads a good block is good, one between good and
bad goes with the nearer.

``learned_lines`` does the same without any cue words: in the first pass stop-word density, length, link density, the site's own
name and the number of the site's pages that repeat a line decide, so it holds for languages and sites that the lists do not
know.  It finds a little less and is a little less exact where the lists do know them.

Scale.  With cue words a map over pages without a shuffle; rows of other file kinds are filtered out before Python.  Without, one
aggregation counts hashed lines per site; only lines that repeat go back to their pages.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import ALL_STOP
from tessera.session import Scratch

# Rules that may be tuned: cue words of notices, menus, sharing, teasers and footers in English, German, French and Spanish.
MENU_WORDS = frozenset(
    w.strip()
    for w in """
    home|start|blog|news|press|docs|documentation|careers|jobs|pricing|prices|products|product|solutions|services|partners|support|help|contact|contact us|about|about us|events|webinars|
    resources|case studies|customers|log in|login|sign in|sign up|register|search|menu|faq|team|shop|archive|newsletter|community|download|downloads|sitemap|accessibility|
    startseite|hilfe|presse|produkte|produkt|lösungen|leistungen|referenzen|kontakt|karriere|über uns|preise|termine|anmelden|registrieren|partner|suche|ressourcen|veranstaltungen|barrierefreiheit|
    accueil|aide|tarifs|produits|produit|études de cas|agenda|carrières|connexion|inscription|à propos|solution|ressources|événements|partenaires|recherche|accessibilité|
    inicio|ayuda|precios|productos|producto|soluciones|servicios|casos de éxito|casos|eventos|empleo|acceder|registrarse|contacto|quiénes somos|sobre nosotros|prensa|recursos|socios|buscar|accesibilidad
    """.split("|")
)
CONTROL = re.compile(
    r"""^\W*(?:
    skip\ to\ .*|jump\ to\ .*|toggle\ .*|open\ menu|close\ menu|menu|search(?:\ this\ site)?|back\ to\ top|scroll\ .*|load\ more|show\ more|view\ all|see\ all|read\ more|more
    |(?:accept|allow|reject|decline|manage|save)\ (?:all|selection|optional|preferences|cookies|settings|choices).*|got\ it|ok(?:ay)?|cookie\ (?:settings|policy|preferences|notice)|cookies|necessary\ only
    |copy\ link|save\ for\ later|bookmark|share(?:\ (?:this|on|via|with|article|link|page|post)\b.{0,30})?|tweet.{0,30}|print(?:\ this\ page)?|like(?:\ \(\d+\))?|email\ this.*|post\ .{0,15}send|pin\ it
    |\d+\ (?:shares?|comments?|likes?|views?)|(?:leave|add|post|write)\ a\ (?:comment|reply)|no\ comments.*|comments?(?:\ \(\d+\))?
    |advertisement|sponsored(?:\ content|\ post)?|ad|promoted|sitemap|accessibility|imprint|terms.{0,25}|privacy.{0,12}(?:notice|policy)
    |(?:next|previous|older|newer)\ (?:post|article|page|entry)s?\W*|page\ [\d\s….]+|tags?\s*:.*|filed\ under.*|categor(?:y|ies)\s*:.*|language\s*:.*|[A-Z]{2}(?:\s*[|/·]\s*[A-Z]{2})*
    |follow\ us.*|subscribe(?:\ now)?|sign\ up(?:\ now)?|log\ in|sign\ in|all\ rights\ reserved
    |zum\ inhalt.*|menü.{0,20}|suche\ .{0,15}|navigation\ .{0,20}|nach\ oben|mehr\ (?:laden|anzeigen|erfahren)|alle\ (?:akzeptieren|ablehnen|zulassen)|nur\ notwendige.*|auswahl\ .{0,15}|einstellungen|cookie-einstellungen|verstanden|ablehnen
    |link\ kopieren|merken|für\ später.{0,12}|artikel\ (?:teilen|drucken|merken)|(?:seite\ )?drucken|teilen.{0,30}|gefällt\ mir.*|\d+\ mal\ geteilt|\d+\ kommentare?|kommentar\ (?:schreiben|hinterlassen)|anzeige|werbung|gesponsert.{0,15}
    |(?:nächster|vorheriger|älterer|neuerer)\ (?:beitrag|artikel)\W*|seite\ [\d\s….]+|schlagw\w+\s*:.*|sprache\s*:.*|folgen\ sie\ uns.*|impressum.{0,40}|datenschutz(?:\W+agb.*|erklärung)?|agb|barrierefreiheit
    |aller\ au\ .*|ouvrir\ le\ menu|afficher\ .{0,25}|menu\ principal|rechercher?.{0,20}|haut\ de\ page|retour\ en\ haut|(?:voir|charger|afficher)\ plus|tout\ (?:accepter|refuser|autoriser)|(?:accepter|refuser|personnaliser|paramétrer)(?:\ tout)?|gérer\ (?:les\ )?(?:cookies|préférences|choix)|j'ai\ compris|continuer\ sans\ accepter
    |copier\ le\ lien|enregistrer.{0,20}|partager.{0,40}|imprimer.{0,15}|j'aime.*|\d+\ (?:partages?|commentaires?)|(?:laisser|ajouter|écrire)\ un\ commentaire|publicité|contenu\ sponsorisé|sponsorisé
    |article\ (?:suivant|précédent)\W*|étiquettes?\s*:.*|mots-clés\s*:.*|langue\s*:.*|suivez-nous.*|mentions\ légales(?:\W.*)?|confidentialité|plan\ du\ site|accessibilité
    |saltar\ a.*|ir\ al\ contenido|abrir\ (?:el\ )?menú|mostrar\ .{0,20}|volver\ arriba|(?:ver|cargar|mostrar)\ más|(?:aceptar|rechazar|permitir)(?:\ tod[oa]s?|\ selección)?|configurar(?:\ cookies)?|gestionar.{0,20}|solo\ necesarias|entendido
    |copiar\ (?:el\ )?enlace|guardar.{0,20}|compartir.{0,40}|imprimir(?:\ página)?|me\ gusta.*|\d+\ (?:veces\ compartido|compartidos?|comentarios?)|(?:dejar|escribir|añadir)\ un\ comentario|publicidad|contenido\ patrocinado|patrocinado
    |(?:entrada|artículo)\ (?:siguiente|anterior)\W*|página\ [\d\s….]+|etiquetas?\s*:.*|idioma\s*:.*|síganos.*|aviso\ legal(?:\W.*)?|privacidad|mapa\ (?:web|del\ sitio)|accesibilidad
    )\W*$""",
    re.I | re.X,
)
TEASER_HEAD = re.compile(
    r"""^\W*(?:popular(?:\ (?:this\ week|now|posts?|articles?))?|trending(?:\ now)?|most\ (?:read|popular|viewed)|related\ (?:articles?|posts?|stories|content|links)|read\ (?:next|also)|you\ (?:may|might)\ also\ like|recommended(?:\ for\ you)?|more\ (?:from|on|in|stories|articles)\b.{0,40}|latest\ (?:posts?|articles?|news)|recent\ (?:posts?|articles?)|keep\ reading|up\ next|don't\ miss
    |meistgelesen|das\ könnte\ sie\ auch\ interessieren|ähnliche\ (?:beiträge|artikel|themen)|mehr\ (?:von|aus|zum\ thema)\b.{0,40}|weitere\ (?:beiträge|artikel)|lesen\ sie\ auch|auch\ interessant|beliebt(?:e\ beiträge)?|neueste\ (?:beiträge|artikel)|empfohlen.{0,20}|im\ trend
    |les\ plus\ lus|à\ lire\ (?:aussi|ensuite|également)|articles?\ (?:liés?|similaires?|connexes?|récents?)|vous\ aimerez\ aussi|sur\ le\ même\ (?:sujet|thème)|plus\ (?:de|d'articles)\b.{0,40}|tendances?|populaires?(?:\ .{0,20})?|cela\ pourrait\ .{0,30}|autres\ articles|à\ découvrir
    |lo\ más\ leído|artículos\ (?:relacionados|similares|recientes)|también\ le\ puede\ interesar|te\ puede\ interesar|le\ puede\ interesar|más\ (?:de|en|artículos)\b.{0,40}|lea\ también|leer\ también|entradas\ (?:relacionadas|recientes)|tendencias?|populares?(?:\ .{0,20})?|a\ continuación|otros\ artículos
    )\W*$""",
    re.I | re.X,
)
READING_TIME = re.compile(r"(?:[—–·|-]\s*|\()\d+\s*min\b[^.!?]{0,20}\)?\s*$", re.I)
ADDRESSED = re.compile(
    r"\b(?:you|your|yours|subscribe|join|sign up|download|book a|enjoying|want|get|we use|others are optional|ihr|ihre|ihrem|ihren|ihnen|jetzt|bestellen|abonnieren|vereinbaren sie|wir verwenden|wir nutzen|jeden|vous|votre|vos|abonnez|recevez|demandez|inscrivez|téléchargez|nous utilisons|usted|su|sus|suscríbase|suscríbete|reciba|pida|descargue|usamos|utilizamos|puede|si continúa|en poursuivant)\b",
    re.I,
)
NOTICE = re.compile(
    r"\b(?:cookies?|cookie policy|privacy|newsletter|inbox|spam|unsubscribe|free demo|walkthrough|template|optional technolog|small files|preferences|store information|on your device|every (?:monday|tuesday|wednesday|thursday|friday|week)|datenschutz|kostenlose vorführung|vorlage|speichern informationen|auf ihrem gerät|postfach|donnerstag|wöchentlich im postfach|infolettre|lettre|démonstration gratuite|modèle|stockent des informations|sur votre appareil|chaque (?:lundi|mardi|mercredi|jeudi|vendredi|semaine)|boletín|demostración gratuita|plantilla|almacenan información|guardan información|en su dispositivo|cada (?:lunes|martes|miércoles|jueves|viernes|semana)|spams?|désinscri|einwilligung|consent)",
    re.I,
)
FOOTER = re.compile(
    r"©|\(c\)\s*\d{4}|\bcopyright\s+\d{4}|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados|^made with \w+ by\b|^mit \w+ gemacht\b|^registered in\b|^eingetragen\b|^immatriculée?\b|^inscrita? en\b|"
    r"\b(?:terms of use|privacy notice|privacy policy|mentions légales|aviso legal|plan du site|mapa web|cookie settings|impressum)\b.*[·|/]|[·|/].*\b(?:terms of use|privacy notice|privacy policy|mentions légales|aviso legal|plan du site|mapa web|imprint|impressum|datenschutz|agb)\b|^follow us\b|^folgen sie\b|^suivez-nous\b|^síganos\b|"
    r"^hergestellt\b|^fait avec\b|^hecho con\b|^powered by\b",
    re.I,
)
LINK = re.compile(r"!?\[([^\]\[]{0,300})\]\(([^)\s]{0,2000})\)|https?://\S+|\[[^\]\n]{1,40}\](?!\()")
PERSONAL = re.compile(r"\b(?:you|your|subscribe|optional|ihre|ihr|vous|votre|usted|su)\b", re.I)
HEADING = re.compile(r"^#{1,6}\s")
CODE_SIGNS = re.compile(r"[=(){}\[\];]|```")
LIST_MARK = re.compile(r"^\s*(?:[-*•+–]|\d{1,3}[.)])\s+")
CODE = re.compile(r"^\s*(?:```|~~~|[\w.\[\]]+ *(?:\+?=|:=) *\S.*[()\[\]{};]|(?:def|class|import|from|return|for|while|if|else|elif|print|const|let|var|function)\b.*[:;(){}]?$|[{}()\];]+$|#!|\$ |>>> )")
CODE_START = re.compile(r"^\s*(?:def|class|import|return|print|const|let|var|function)\b")
SENTENCE = re.compile(r"[.!?…][\"'»”“’)\]]*$")
WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
MENU_SEPARATORS = re.compile(r"\s+[/·|›»>•–-]\s+|\s{2,}|\t+")
SITE_SUFFIX = r"(?:\s(?:Lab|Notes|Journal|Media|Blog|Magazine|News))?"
PAGE = r"(?i)\.(html|htm|md)$"

GOOD, BAD, OPEN = 1, -1, 0


def _folded(text: str) -> str:
    return " ".join(re.findall(r"\w+", text.lower().replace("_", " ")))


def site_name(source: str | None, text: str) -> str | None:
    """What the site calls itself, from its address or its copyright line."""
    m = re.match(r"\s*https?://(?:www\d?\.)?([^./]+)", source or "")
    if m:
        name = re.sub(r"\d+$", "", m.group(1))
        if len(name) > 2:
            return name
    m = re.search(r"(?:©|copyright)\s*\d{4}\s+([^\W\d_]{3,})", text, re.I) or re.search(r"^(?:made with \w+ by the|.{0,30}\bpartners\b) ([^\W\d_]{3,})", text, re.I | re.M)
    return m.group(1) if m else None


def _is_menu(line: str) -> bool:
    """A single line of several short entries, such as 'Home / Blog / About us'."""
    parts = [p.strip(" [](){}") for p in MENU_SEPARATORS.split(line.strip()) if p.strip(" /·|›»>•–-")]
    if len(parts) < 3 or max(map(len, parts)) > 40 or SENTENCE.search(line):
        return False
    known = sum(p.lower() in MENU_WORDS or bool(CONTROL.match(p)) for p in parts)
    return 2 * known >= len(parts)


@lru_cache(maxsize=100_000)
def _is_control(bare: str, listed: bool) -> bool:
    """A short line that is a control, a menu entry or the heading of teasers; such lines recur from page to page."""
    if bare.strip(" []().:!").lower() in MENU_WORDS:
        return True
    return not listed and bool(CONTROL.match(bare) or TEASER_HEAD.match(bare))


def _decide(line: str, site: re.Pattern | None) -> int:
    """First pass, one line."""
    text = line.strip()
    bare = LIST_MARK.sub("", text).strip()
    if "](" in bare or "http" in bare or "[" in bare:
        label = LINK.sub(lambda m: m.group(1) or "", bare)
        rest = LINK.sub("", bare)
        if rest != bare and (len(re.sub(r"\W", "", rest)) <= 0.3 * max(1, len(re.sub(r"\W", "", label))) or not re.search(r"\w", rest)):
            return BAD
    listed = bare is not text and bool(LIST_MARK.match(text))
    if len(bare) <= 80 and _is_control(bare, listed):
        return BAD
    ends = bool(SENTENCE.search(bare[-12:]))
    if len(bare) <= 400 and not ends and _is_menu(bare):
        return BAD
    words = bare.split()
    n = len(words)
    if n < 45 and len(bare) <= 800:
        named = bool(site and site.search(bare))
        if n < 40 and FOOTER.search(bare) and not (n > 14 and ends and not named):
            return BAD
        if (named or n < 22) and NOTICE.search(bare) and ADDRESSED.search(bare) and (named or PERSONAL.search(bare)):
            return BAD
        if named and n < 16 and (re.fullmatch(r"\W*" + site.pattern + r"\W*", bare, re.I) or re.match(r"\W*" + site.pattern + r",\s.*\d", bare, re.I)):
            return BAD
    if text.startswith((">", "|")) or text.startswith("#") and HEADING.match(text) or CODE.match(line) and (CODE_START.match(line) or CODE_SIGNS.search(line)):
        return GOOD
    if not ends and READING_TIME.search(bare[-40:]):
        return BAD
    if listed:
        return GOOD
    if n >= 8 and (ends or len(bare) > 160):
        stop = sum(w in ALL_STOP for w in bare.lower().replace("'", " ").replace("’", " ").split())
        if ends and stop >= 0.15 * n or len(bare) > 160 and stop >= 0.2 * n:
            return GOOD
    return OPEN


OWN_VOICE = re.compile(r"\b(?:you|your|we|our|ihr|ihre|wir|unser\w*|vous|votre|nous|notre|usted|su|sus|nuestr\w+)\b", re.I)


def line_key(line: str) -> int:
    """What lines of a site are compared by: their words, all numbers alike."""
    return int.from_bytes(hashlib.blake2b(re.sub(r"\d+", "0", _folded(line)).encode(), digest_size=8).digest(), "big", signed=True)


def _decide_learned(line: str, site: re.Pattern | None, pages: int) -> int:
    """First pass, one line, without cue words; ``pages``: how many pages of the site have the line."""
    text = line.strip()
    bare = LIST_MARK.sub("", text).strip()
    label, rest = LINK.sub(lambda m: m.group(1) or "", bare), LINK.sub("", bare)
    if rest != bare and len(re.sub(r"\W", "", rest)) <= 0.3 * max(1, len(re.sub(r"\W", "", label))):
        return BAD
    ends = bool(SENTENCE.search(bare[-12:]))
    if text.startswith((">", "|")) or HEADING.match(text) or CODE.match(line) and (CODE_START.match(line) or CODE_SIGNS.search(line)):
        return GOOD
    if not ends and READING_TIME.search(bare[-40:]):
        return BAD
    if bare is not text and LIST_MARK.match(text):
        return GOOD
    words, named = bare.split(), bool(site and site.search(bare))
    parts = [p for p in MENU_SEPARATORS.split(text) if p.strip()]
    if len(parts) >= 3 and max(map(len, parts)) <= 60 and not SENTENCE.search(text):
        return BAD
    stop = sum(w in ALL_STOP for w in bare.lower().replace("'", " ").replace("’", " ").split())
    good = len(words) >= 8 and (ends and stop >= 0.15 * len(words) or len(bare) > 160 and stop >= 0.2 * len(words))
    if named and (pages > 1 or len(words) < 16 or len(words) < 30 and OWN_VOICE.search(bare)):
        return BAD
    if good:
        return BAD if pages > 2 and len(words) < 24 else GOOD
    return BAD if pages > 1 else OPEN


def _title_line(lines: list[str], filename: str | None, source: str | None, labels: list[int]) -> int | None:
    """Number of the line that opens the main body: the page's own title."""
    stem = _folded(re.sub(r"\.\w+$", "", filename or ""))
    slug = re.sub(r"[^a-z0-9]+", "-", (source or "").rstrip("/").rsplit("/", 1)[-1].lower()).strip("-")
    match = []
    for k, line in enumerate(lines):
        if len(line) > 300 or not line.strip():
            continue
        heading = re.match(r"^#\s+\S", line)
        name = _folded(line)
        if heading:
            return k
        if name and (name == stem or (slug and re.sub(r"[^a-z0-9]+", "-", line.strip().lower()).strip("-") == slug)):
            match.append(k)
    if not match:
        return None
    first = next((k for k, line in enumerate(lines) if labels[k] == GOOD and len(line) > 140 and k > match[0]), len(lines))
    return max(k for k in match if k == match[0] or k < first)


def _teasers(lines: list[str], blank: list[bool], labels: list[int], opening: int | None) -> None:
    """Marks the titles, links and single sentences that follow a heading such as "Read next" without a blank line.

    Sentences belong to it only where each title has one; otherwise the first sentence is the body again.
    """
    n = len(lines)

    def body(j: int) -> bool:
        s = lines[j].strip()
        return bool(re.match(r"^#{1,6}\s|^[>|]|^```", s)) or len(s) > 220 or bool(LIST_MARK.match(s) and labels[j] == GOOD and not READING_TIME.search(s))

    def sentence(j: int) -> bool:
        return j < n and not blank[j] and not body(j) and labels[j] == GOOD

    def ends(j: int) -> bool:
        return j >= n or blank[j] or body(j)

    k = 0
    while k < n:
        if not (labels[k] == BAD and TEASER_HEAD.match(lines[k].strip()) and (opening is None or k > opening)):
            k += 1
            continue
        j = k + 1
        described = sentence(j + 1) and (ends(j + 2) and (j + 2 >= n or blank[j + 2]) or j + 2 < n and labels[j + 2] != GOOD)
        while not ends(j) and j != opening:
            if sentence(j) and not (described and j > k + 1 and not sentence(j - 1)):
                break
            short = labels[j] == OPEN and len(lines[j].split()) <= 3 and not READING_TIME.search(lines[j])
            if short and not described and j > k + 1 and j + 1 < n and not blank[j + 1] and (body(j + 1) or sentence(j + 1)):
                break  # a heading of the body
            j += 1
        for i in range(k + 1, j):
            labels[i] = BAD
        k = max(j, k + 1)


def line_labels(text: str, filename: str | None = None, source: str | None = None, repeats: dict[int, int] | None = None) -> list[bool | None]:
    """For each line of the page: True for main body, False for boilerplate, None for blank lines.

    ``repeats``: pages of the site per line key; if given, they decide instead of cue words.
    """
    lines = text.split("\n")
    name = site_name(source, text)
    site = re.compile(re.escape(name) + SITE_SUFFIX, re.I) if name else None
    labels, fenced = [], False
    for line in lines:
        fence = line.lstrip().startswith(("```", "~~~"))
        if fenced or fence:
            labels.append(GOOD)
        elif repeats is None:
            labels.append(_decide(line, site))
        else:
            labels.append(_decide_learned(line, site, repeats.get(line_key(line), 1)) if line.strip() else OPEN)
        fenced ^= fence
    blank = [not line.strip() for line in lines]

    opening = _title_line(lines, filename, source, labels)
    if opening is not None:
        labels[:opening] = [BAD] * opening
        labels[opening] = GOOD
    if repeats is None:
        _teasers(lines, blank, labels, opening)
    # Second pass: short undecided lines take the label of their nearest decided neighbours.
    decided = [k for k in range(len(lines)) if not blank[k] and labels[k] != OPEN]
    last_good = max((k for k in decided if labels[k] == GOOD), default=-1)
    out: list[bool | None] = []
    for k in range(len(lines)):
        if blank[k]:
            out.append(None)
        elif labels[k] != OPEN:
            out.append(labels[k] == GOOD)
        else:
            p = bisect.bisect_left(decided, k)
            before = decided[p - 1] if p else None
            after = decided[p] if p < len(decided) else None
            if opening is not None and opening < k < last_good and not (before == k - 1 and labels[before] == BAD and after == k + 1 and labels[after] == BAD):
                out.append(True)  # within the body, a short line that is no control heads what follows
            elif after is not None and labels[after] == GOOD and after - k <= 2 and not (before == k - 1 and labels[before] == BAD and after == k + 2):
                out.append(True)  # it heads what follows
            elif before is None or after is None:
                near = after if before is None else before
                out.append(near is not None and labels[near] == GOOD and before is not None and k - before <= 1)
            elif labels[before] == labels[after]:
                out.append(labels[before] == GOOD)
            else:
                near = before if k - before < after - k else after
                out.append(labels[near] == GOOD)
    return out


def _pages(files: DataFrame) -> DataFrame:
    return files.where(F.col("filename").rlike(PAGE) & F.col("text").isNotNull()).select("file_id", "filename", "source", "text")


def _none(x):
    return None if x is None or x != x else x


def boilerplate_lines(files: DataFrame) -> DataFrame:
    """``file_id, line_no``: the non-blank lines, counted from 1, that are not part of the main body.

    files: ``file_id, filename, source, text``; further columns are ignored; files not named as web pages
    (``.html``, ``.htm``, ``.md``, in any case) are left out.

    Defined edge cases: null and empty texts give no row; a null file name is no page; a null source only means
    that the site's name is taken from the page; a page without a recognisable title is judged line by line
    from its start; repeated rows give their lines again; a null ``file_id`` is kept.
    """

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, filename, source, text in zip(batch["file_id"], batch["filename"], batch["source"], batch["text"]):
                rows += [(file_id, k) for k, main in enumerate(line_labels(text, filename, _none(source)), 1) if main is False]
            yield pd.DataFrame(rows, columns=["file_id", "line_no"]).astype({"file_id": "Int64", "line_no": "int32"})

    return _pages(files).mapInPandas(find, "file_id bigint, line_no int")


def learned_lines(files: DataFrame) -> DataFrame:
    """``file_id, line_no`` as ``boilerplate_lines`` gives them, found without cue words.

    A line counts as repeated if two or more pages of its site have it; pages of unknown sites have no repeats.  Edge cases as there.
    """
    scratch = Scratch(files.sparkSession, "lines")
    pages = scratch.write(_pages(files).withColumn("page", F.monotonically_increasing_id()), "pages")  # numbered once, as written

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sites = [(site_name(_none(source), text) or "").lower() for source, text in zip(batch["source"], batch["text"])]
            yield pd.DataFrame({"page": batch["page"], "site": sites, "keys": [list({line_key(x) for x in text.split("\n") if x.strip()}) for text in batch["text"]]})

    lines = pages.select("page", "source", "text").mapInPandas(keys, "page long, site string, keys array<long>").where("site <> ''")
    lines = scratch.write(lines.select("page", "site", F.explode("keys").alias("key")), "keys")
    repeated = lines.groupBy("site", "key").agg(F.count("*").alias("n")).where("n > 1")
    held = lines.join(repeated, ["site", "key"]).groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("repeats"))  # no longer than the page

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for file_id, filename, source, text, repeats in zip(batch["file_id"], batch["filename"], batch["source"], batch["text"], batch["repeats"]):
                labels = line_labels(text, filename, _none(source), dict(repeats) if repeats is not None else {})
                rows += [(file_id, k) for k, main in enumerate(labels, 1) if main is False]
            yield pd.DataFrame(rows, columns=["file_id", "line_no"]).astype({"file_id": "Int64", "line_no": "int32"})

    return pages.join(held, "page", "left").drop("page").mapInPandas(find, "file_id bigint, line_no int")


def main_bodies(files: DataFrame) -> DataFrame:
    """``file_id, main_text``: each page reduced to the lines of its main body; runs of blank lines become one."""

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for filename, source, text in zip(batch["filename"], batch["source"], batch["text"]):
                kept = [line if main is not None else "" for line, main in zip(text.split("\n"), line_labels(text, filename, _none(source))) if main is not False]
                texts.append(re.sub(r"\n{3,}", "\n\n", "\n".join(kept)).strip("\n"))
            yield pd.DataFrame({"file_id": batch["file_id"].astype("Int64"), "main_text": texts})

    return _pages(files).mapInPandas(reduce, "file_id bigint, main_text string")
