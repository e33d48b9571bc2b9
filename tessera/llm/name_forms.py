"""Names of persons and organisations as people type them: parsing into comparable forms, and their similarity."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import lru_cache

# Rules that may be tuned: given names with their everyday short forms, and words that tell kinds of names.
NICKNAMES = {
    "abigail": "abby abbie gail", "alexander": "alex sandy xander sasha", "andrew": "andy drew", "anthony": "tony ant", "barbara": "barb babs", "benedict": "ben benny", "benjamin": "benji",
    "catherine": "cathy cath", "charles": "charlie chuck", "charlotte": "lottie charley", "christina": "tina chrissy", "christopher": "chris kit topher", "daniel": "dan danny", "david": "dave davey",
    "deborah": "deb debbie", "dmitri": "dima mitya", "dorothy": "dot dottie", "edward": "ed eddie ted teddy ned", "eleanor": "nell ellie nora", "elizabeth": "liz beth lizzie eliza betty bess", "emily": "em emmy",
    "franziska": "franzi fanni ziska", "francis": "frank", "frederick": "fred freddy freddie", "gabriela": "gabi gaby", "george": "geordie", "gerald": "gerry", "gregory": "greg", "guillermo": "memo guille", "harriet": "hattie",
    "henry": "hank harry hal", "isabella": "izzy bella isa", "jacob": "jake", "james": "jim jimmy jamie", "jennifer": "jen jenny", "jessica": "jess jessie", "john": "johnny jack", "jonathan": "jon jonny", "joseph": "joe joey",
    "josephine": "josie jo", "katherine": "kate kathy katie kat kitty", "kenneth": "ken kenny", "laurence": "larry", "leopold": "leo poldi", "magdalena": "lena magda", "margaret": "maggie peggy meg greta", "martin": "marty",
    "matthew": "matt", "michael": "mike mick mickey", "nathaniel": "nate nat", "nicholas": "nick nicky klaus", "oluwaseun": "seun", "pamela": "pam", "patricia": "pat patty trish", "patrick": "paddy", "peter": "pete", "philip": "phil",
    "philippa": "pippa pip", "rebecca": "becky becca", "richard": "rick dick rich", "robert": "rob bob bobby robbie bert", "ronald": "ron", "samuel": "sam", "sebastian": "seb bastian", "stephen": "steve", "susannah": "sue susie suzy sanna",
    "theodora": "dora thea theo", "theodore": "theodor", "thomas": "tom tommy", "timothy": "tim", "veronica": "ronnie vera nica", "victoria": "vicky tori", "vincent": "vince", "walter": "walt wally", "william": "bill will billy liam willy", "zoltan": "zoli zolly",
}
TITLES = frozenset("dr prof mr mrs ms miss sir dame herr frau mme m mlle sr sra dipl ing rev hon professor doctor".split()) - {"m"}
LEGAL = frozenset("ltd limited llc inc incorporated gmbh ag sa oy ab as nv bv corp corporation co company group plc kg sarl srl spa holding holdings lp llp pty se".split())
INDUSTRY = frozenset(
    """media travel pharmacy research retail publishing analytics interactive measurement insights broadcast broadcasting telecom apparel optics robotics audio panels foods beverages finance logistics mobility games
    outdoor labs laboratories systems technologies software consulting consultants partners energy pharma bank banking insurance motors industries textiles studios pictures records press solutions services networks digital""".split()
)
BODIES = frozenset("alliance bureau federation institute council committee association foundation society union agency authority commission ministry university college academy board chamber consortium department office".split())
SMALL = frozenset("the of and for de la le les del der die das und et & van von zu".split())
#: Heads of terms, documents, events and places, none of which are persons or organisations.
TERM_WORDS = frozenset(
    """function transform model score ratio constraint estimate test effect window index curve scenario term equation framework method approach concept theory family guide notes handbook review manual report summit workshop forum
    launch hearing conference region county district province version lite core studio panel trend step mix halo prior price reach lift decay saturation carryover holdout consent
    frequency promotion forecast response spend budget channel attribution audience seasonal bayesian causal nested pooled dynamic sparse delayed stacked blended logistic hierarchical robust baseline adaptive
    truncated geometric latent incremental calibrated weighted weibull marginal""".split()
)
FOLD = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "’": "'"})
GIVEN = {short: full for full, shorts in NICKNAMES.items() for short in shorts.split()} | {full: full for full in NICKNAMES}
FORMAL_BY_LETTER: dict[str, list[str]] = {}
for _n in NICKNAMES:
    FORMAL_BY_LETTER.setdefault(_n[0], []).append(_n)


@lru_cache(maxsize=100_000)
def folded(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower().translate(FOLD)) if not unicodedata.combining(c))


@lru_cache(maxsize=200_000)
def edits(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours; 9 if clearly more than 2."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 9
    # Equal beginnings and ends cost nothing, so words of any length are compared; one letter of each stays for swaps.
    n = min(len(a), len(b))
    head = next((k for k in range(n) if a[k] != b[k]), n)
    tail = next((k for k in range(n - head) if a[-1 - k] != b[-1 - k]), n - head)
    a, b = a[max(0, head - 1) : len(a) - max(0, tail - 1)], b[max(0, head - 1) : len(b) - max(0, tail - 1)]
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > 2:
            return 9
        before, row = row, new
    return row[-1]


def misspelt(a: str, b: str, strict: bool = False) -> bool:
    """Are these likely one word with typing errors?  The first letter is rarely hit.

    ``strict``, for surnames, of which many are alike: two errors need the same first two letters.
    """
    if a == b:
        return True
    short = min(len(a), len(b))
    if short < 4 or a[0] != b[0] and not (a[1:2] == b[0] and b[1:2] == a[0]):
        return False
    d = edits(a, b)
    return d <= 1 or d == 2 and short >= 5 and (not strict or sorted(a[:2]) == sorted(b[:2]))


def abbreviates(a: str, b: str) -> bool:
    """Is ``a`` a cut or contracted form of ``b``: same first letter, its letters in order, clearly shorter?"""
    if not (2 <= len(a) < len(b)) or a[0] != b[0] or len(a) > 0.75 * len(b) or len(b) < 5:
        return False
    if b.startswith(a):
        return len(a) >= 3
    rest = iter(b)
    return all(c in rest for c in a) and (len(a) >= 3) and not set("aeiou").issuperset(a[1:])


def word_similarity(a: str, b: str, strict: bool = False) -> float:
    if a == b:
        return 1.0
    if misspelt(a, b, strict):
        return 1.0 - edits(a, b) / (2 + max(len(a), len(b)))
    if abbreviates(a, b) or abbreviates(b, a):
        return 0.9
    if len(a) == 1 and len(b) > 3 and a == b[0] or len(b) == 1 and len(a) > 3 and b == a[0]:
        return 0.8  # a word given by its initial
    return 0.0


def monge_elkan(a: list[str], b: list[str], strict: bool = False) -> tuple[float, float]:
    """Monge–Elkan similarity, that is the mean over the words of one name of their best similarity to a word of the other, the
    lesser of both directions; and the least of these best similarities."""
    if not a or not b:
        return 0.0, 0.0
    table = [[word_similarity(x, y, strict) for y in b] for x in a]
    of_a, of_b = [max(row) for row in table], [max(column) for column in zip(*table)]
    return min(sum(of_a) / len(a), sum(of_b) / len(b)), min(min(of_a), min(of_b))


#: A string of more words is a text, one with a longer word is neither.
MOST_WORDS, MOST_LETTERS = 40, 100


@dataclass(frozen=True)
class Form:
    """A parsed name.  kind: person, initial (person by initial), org, stem (organisation by one word), acronym, name (a person or
    organisation by its votes alone) or other."""

    kind: str
    words: tuple[str, ...]  # person: given name or initial, surname(s); otherwise the significant words

    @property
    def key(self) -> str:
        return self.kind + "|" + " ".join(self.words if self.kind in ("person", "initial", "acronym") else sorted(self.words))


@lru_cache(maxsize=100_000)
def given_name(word: str) -> str | None:
    """The formal given name that a word stands for, typing errors allowed."""
    if word in GIVEN:
        return GIVEN[word]
    if len(word) >= 5:
        near = [n for letter in {word[0], word[1]} for n in FORMAL_BY_LETTER.get(letter, ()) if misspelt(word, n) and edits(word, n) <= (1 if min(len(word), len(n)) < 8 else 2)]
        near = near or [n for n in NICKNAMES if len(n) == len(word) >= 6 and n[1:] == word[1:]]  # a wrong first letter
        if len(near) == 1:
            return near[0]
        if near:
            return min(near, key=lambda n: (edits(word, n), n))
    return None


@lru_cache(maxsize=100_000)
def _legal(word: str) -> bool:
    """A legal form at the end of a name, typing errors allowed."""
    if word in LEGAL:
        return True
    if len(word) < 3 or word in INDUSTRY or word in BODIES or word in TERM_WORDS:
        return False
    return any(len(x) >= 3 and x[0] == word[0] and abs(len(x) - len(word)) <= 1 and len(word) >= len(x) - (len(x) > 3) and edits(word, x) <= 1 for x in LEGAL)


def _is_org_word(word: str) -> bool:
    if word in INDUSTRY or word in BODIES:
        return True
    if word in TERM_WORDS or len(word) < 3:
        return False
    known = _ORG_BY_LETTER.get(word[0], ())
    if len(word) >= 4 and any(misspelt(word, x) for x in known):
        return True
    return sum(c in "aeiou" for c in word) <= 1 and any(abbreviates(word, x) for x in known)  # contracted, as in bcast


_ORG_BY_LETTER: dict[str, list[str]] = {}
for _n in INDUSTRY | BODIES:
    if len(_n) >= 5:
        _ORG_BY_LETTER.setdefault(_n[0], []).append(_n)
_is_org_word = lru_cache(maxsize=100_000)(_is_org_word)


@lru_cache(maxsize=100_000)
def _is_body(word: str) -> bool:
    """A word for an institution, misspelt or contracted as it may be."""
    if word in BODIES:
        return True
    near = (x for x in BODIES if len(x) >= 5 and x[0] == word[0])
    return any(misspelt(word, x) or abbreviates(word, x) and (len(word) >= 5 or sum(c in "aeiou" for c in word) <= 1) for x in near)


def parse(name: str, person_votes: int = 0, org_votes: int = 0, other_votes: int = 0) -> Form:
    """The form of a name.  Votes (how often its rows are typed so) decide only where words do not.

    A string of more than ``MOST_WORDS`` words, or with a word of more than ``MOST_LETTERS``, is no name of a person or organisation.
    """
    if len(name) > 2 * MOST_WORDS:
        first = name.split(None, MOST_WORDS)
        if len(first) > MOST_WORDS or any(len(w) > MOST_LETTERS for w in first):
            return Form("other", ())
    text = re.sub(r"\s+", " ", re.sub(r"(?<=\S)\s*\([^()]*\)", " ", name)).strip()
    dotted = re.fullmatch(r"(?:[^\W\d_]\.){2,6}[^\W\d_]?\.?", text)
    if dotted or re.fullmatch(r"[^\W\d_a-z]{2,6}", text) and text.upper() == text and folded(text) not in GIVEN:
        return Form("acronym", (folded(text).replace(".", ""),))
    split = re.sub(r"(?<=[^\W\d_A-Z])(?=[A-ZÀ-ÖØ-Þ][^\W\d_A-Z])", " ", text)
    raw = [w for w in re.findall(r"[^\W_]+(?:['’][^\W\d_]+)?(?:\.[^\W\d_])*\.?|,|&", split.replace("-", " "))]
    words = [folded(w).replace(".", "").replace("'", "") for w in raw]
    comma = words.index(",") if "," in words else None
    plain = [w for w in words if w != ","]
    if len(plain) == 1:  # two words run together in lower case
        tail = next((x for x in INDUSTRY if len(x) >= 5 and plain[0].endswith(x) and len(plain[0]) >= len(x) + 4), None)
        if tail:
            plain = [plain[0][: -len(tail)], tail]
    if not any(any(c.isalpha() for c in w) for w in plain):
        return Form("other", tuple(plain))
    numbered = any(any(c.isdigit() for c in w) for w in plain)  # no word of a person
    body = list(plain)
    while len(body) > 1 and (_legal(body[-1]) or len(body) > 2 and 1 <= len(body[-1]) <= 3 and any(map(_is_org_word, body[:-1])) and any(len(x) <= 3 and edits(body[-1], x) <= 1 for x in LEGAL)):
        body.pop()
    had_legal = len(body) < len(plain)
    significant = [w for w in body if w not in SMALL]
    org_words = [w for w in significant if w not in GIVEN and _is_org_word(w)]
    short_org = any(len(w) >= 3 and raw[words.index(w)].endswith(".") for w in significant if w in words and w not in TITLES)
    shouted = text.upper() == text
    typed = dict(zip(words, raw))
    in_titles = [w for w in significant if w not in TITLES or len(significant) == 1 or (len(w) == 2 and typed.get(w, "").isupper() and not shouted and len(significant) == 2)]
    known = [given_name(w) for w in in_titles]
    exact = [w in GIVEN for w in in_titles]
    bodies = any(map(_is_body, significant))
    if 2 <= len(in_titles) <= 4 and not numbered and not org_words and not any(w in TERM_WORDS for w in in_titles):
        initials = [k for k, w in enumerate(in_titles) if len(w) == 1 and (typed.get(w, "").isupper() or "." in typed.get(w, ""))]
        run_in = [k for k, w in enumerate(in_titles) if len(w) == 2 and k in (0, len(in_titles) - 1) and typed.get(w, "").isupper() and not shouted]
        for k in run_in:
            known[k], exact[k] = None, False
        votes_person = person_votes >= 1 and person_votes > org_votes and person_votes > 2 * other_votes and not had_legal
        if any(known) or (initials or run_in) and len(in_titles) - len(initials) - len(run_in) == 1 and not had_legal or votes_person:
            return _person(in_titles, known, exact, initials + run_in, comma is not None)
    if not significant:
        return Form("other", tuple(plain))
    voted_org = org_votes >= 2 and org_votes > person_votes and org_votes > 2 * other_votes
    if org_words or had_legal or short_org or bodies and len(significant) >= 3 or (voted_org and not any(w in TERM_WORDS for w in significant)):
        if len(significant) == 1:
            return Form("stem", tuple(significant))
        return Form("org", tuple(significant)) if not (len(significant) > 1 and any(w in TERM_WORDS for w in significant) and not bodies and not had_legal) else Form("other", tuple(significant))
    if len(significant) == 1 and len(significant[0]) >= 4 and (other_votes <= person_votes + org_votes or text[0].isupper()):
        return Form("stem", tuple(significant))
    if len(significant) >= 3 and other_votes <= org_votes + person_votes and any(abbreviates(w, x) for w in significant for x in BODIES):
        return Form("org", tuple(significant))
    meant = person_votes + org_votes
    return Form("name" if meant >= 2 and meant > 2 * other_votes else "other", tuple(significant))


def _person(words: list[str], known: list[str | None], exact: list[bool], initials: list[int], comma: bool) -> Form:
    n = len(words)
    firsts = [k for k in range(n) if exact[k]] or [k for k in range(n) if known[k]]
    full = [k for k in range(n) if k not in initials]
    if firsts and len(full) >= 2:
        first = firsts[-1] if comma and firsts[-1] != 0 else firsts[0]
        if first == 0 and comma and len(full) >= 2 and known[full[-1]]:
            first = full[-1]
        rest = [words[k] for k in full if k != first]
        return Form("person", (known[first] or words[first], *rest))
    if initials and len(full) == 1:
        first = words[initials[0]][0]
        return Form("initial", (first, words[full[0]]))
    if comma:
        return Form("person", (words[full[-1]], *[words[k] for k in full[:-1]])) if len(full) > 1 else Form("other", tuple(words))
    return Form("person", (words[full[0]], *[words[k] for k in full[1:]])) if len(full) > 1 else Form("other", tuple(words))


def same_entity(a: Form, b: Form) -> tuple[float, bool]:
    """Similarity of two forms (0: not the same), and whether it is weak, that is, holds only if no other name fits."""
    kinds = {a.kind, b.kind}
    if kinds == {"person"} or kinds == {"initial"}:
        given = word_similarity(a.words[0], b.words[0]) if kinds == {"person"} else float(a.words[0] == b.words[0])
        if not given or (kinds == {"person"} and a.words[0] != b.words[0] and a.words[0] in NICKNAMES and b.words[0] in NICKNAMES):
            return 0.0, False
        mean, least = monge_elkan(list(a.words[1:]), list(b.words[1:]), strict=True)
        # Surnames decide; the score is the Monge–Elkan similarity of all words, each surname weighing as much as the given name.
        n = (len(a.words) + len(b.words)) / 2
        return ((given + (n - 1) * mean) / n, False) if least >= 0.75 else (0.0, False)
    if kinds == {"person", "initial"}:
        short, full = (a, b) if a.kind == "initial" else (b, a)
        if short.words[0] != full.words[0][0]:
            return 0.0, False
        mean, least = monge_elkan(list(short.words[1:]), list(full.words[1:]), strict=True)
        return (mean, True) if least >= 0.75 else (0.0, False)
    if kinds == {"stem"} or kinds <= {"org", "name"}:
        mean, least = monge_elkan(list(a.words), list(b.words))
        by_initial = any(len(w) == 1 for w in a.words) != any(len(w) == 1 for w in b.words)
        return (mean, by_initial) if least >= 0.7 and mean >= 0.85 else (0.0, False)
    if kinds == {"org", "stem"}:
        short, full = (a, b) if a.kind == "stem" else (b, a)
        rest = [w for w in full.words if not _is_org_word(w)]
        if len(full.words) == 2 and len(rest) == 1 and misspelt(short.words[0], rest[0]):
            return word_similarity(short.words[0], rest[0]), True
        return 0.0, False
    if kinds == {"org", "acronym"}:
        short, full = (a, b) if a.kind == "acronym" else (b, a)
        return (0.9, True) if len(full.words) >= 3 and "".join(w[0] for w in full.words) == short.words[0] else (0.0, False)
    return 0.0, False


def blocking_sets(form: Form) -> list[tuple[str, list[str], bool]]:
    """``(view, grams, exact)``: what a form is looked up by.  Exact views are one key; others are banded over their grams."""

    def grams(word: str) -> list[str]:
        padded = "^" + word + "$"
        return [padded[i : i + 2] for i in range(len(padded) - 1)]

    if form.kind in ("person", "initial"):
        return [("p" + form.words[0][0], grams(w), False) for w in dict.fromkeys(form.words[1:])]  # any surname word may be the one without errors
    if form.kind == "stem":
        return [("s", grams(form.words[0]), False)]
    if form.kind == "acronym":
        return [("a", ["".join(sorted(form.words[0]))], True)]
    if form.kind == "name":
        return [("o", [g for w in sorted(form.words) for g in grams(w)], False)]
    if form.kind == "org":
        views = [("o", [g for w in sorted(form.words) for g in grams(w)], False)]
        rest = [w for w in form.words if not _is_org_word(w)]
        if len(form.words) == 2 and len(rest) == 1:
            views.append(("s", grams(rest[0]), False))
        if len(form.words) >= 3:
            views.append(("a", ["".join(sorted(w[0] for w in form.words))], True))
        return views
    return []
