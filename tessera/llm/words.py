"""Fixed word lists per language, shared by the text operators.

CLAUSE: conjunctions, pronouns and auxiliary verbs, which sentences need and keyword lists lack.
FUNCTION: further function words, which together with CLAUSE make up the stop words.
"""

# Common function words of four languages.
CLAUSE = {
    "en": "and but that is was were are be been because although if when while which who it its they he she we you this these not only than as there why how what whether whereas".split(),
    "es": "y pero que es son fue se lo porque aunque si cuando su sus según ya más como hay ni esto quien donde cuya mientras había habría".split(),
    "fr": "et qui mais est sont était que ne ce cette parce bien si quand il elle dont selon comme ont été tant puis où avait aurait".split(),
    "de": "und dass ist sind war aber weil obwohl wenn sobald solange was wie es sich nicht er sie wir ihn als doch hat wäre blieb ob noch man".split(),
}
FUNCTION = {
    "en": "the a an of to in on for with at by from or into over under about after before between through our their his her has had have do does did will would can could should may so such each every all any some no nor more most other up out off then".split(),
    "es": "no el la los las un una unos unas de del al a en con por para sin sobre entre desde hasta o también muy cada todo toda todos todas otro otra este esta ese esa le les nos".split(),
    "fr": "on pas plus le la les un une des du de à au aux en dans par pour avec sans sur sous entre depuis jusque ou aussi très chaque tout toute tous toutes autre leur leurs son sa ses nous vous se c d l s n qu".split(),
    "de": "der die das den dem des ein eine einen einem einer eines in im an am auf aus bei mit nach von vom zu zum zur für über unter um vor seit durch ohne gegen oder auch sehr jede jeder jedes alle andere ihr ihre sein seine".split(),
}
LANGS = tuple(CLAUSE)
CLAUSE_SETS = {k: frozenset(v) for k, v in CLAUSE.items()}
STOP_SETS = {k: frozenset(v) | CLAUSE_SETS[k] for k, v in FUNCTION.items()}
ALL_CLAUSE = frozenset().union(*CLAUSE_SETS.values())
ALL_STOP = frozenset().union(*STOP_SETS.values())
