"""Text functions as Spark columns: tokens, stems, hashes, URLs, languages, intents."""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words: letters and digits, joined inside by apostrophe, hyphen or full stop.
TOKEN = r"[\p{L}\p{N}]+(?:['\-.][\p{L}\p{N}]+)*"

# Suffixes a stemmer strips, first match in this order.
SUFFIXES = {
    "en": ["ingly", "edly", "ing", "ies", "ied", "ed", "es", "s"],
    "it": ["azione", "azioni", "mente", "ando", "endo", "ato", "ata", "ati", "ate", "are", "ere", "ire", "i", "e", "a", "o"],
    "de": ["ungen", "ung", "heit", "keit", "lich", "isch", "en", "er", "es", "e", "n"],
    "fr": ["ations", "ation", "ement", "euses", "euse", "eurs", "eur", "es", "er", "s", "e"],
    "es": ["aciones", "ación", "mente", "ando", "iendo", "ado", "ada", "ados", "adas", "ar", "er", "ir", "es", "s"],
    "pt": ["ações", "ação", "mente", "ando", "endo", "ado", "ada", "ados", "adas", "ar", "er", "ir", "es", "s"],
    "nl": ["heden", "heid", "ingen", "ing", "en", "er", "e", "s"],
}

# Function words that are no index terms, by language.
STOP_WORDS = {
    "en": (
        "the and for are was were this that with from have has had not but you your our can will all any its his her they them been more other into than "
        "then when what which who how out about also to of in on at is it as be by do does did or if so up an we us me my am i a no yes get got there here "
        "where why much many some would could should please want need like know tell give show find just very really"
    ).split(),
    "it": (
        "il lo la le gli un una uno di da in su per con tra fra che chi cui non come dove quando anche ancora della delle dello degli del dei nel nella sono "
        "essere questo questa questi queste quello più molto tutto tutti al ai agli alla alle allo e o ma se si ci vi ne mi ti lui lei noi voi loro ho hai ha "
        "è era sia quanto quanti quale quali cosa vorrei voglio posso puoi può grazie prego ecco"
    ).split(),
    "de": (
        "der die das den dem des ein eine einen einem und oder aber mit von für auf aus bei nach ist sind war nicht auch wenn wie wir sie ich sich werden "
        "wurde kann haben hat zu im am an in es er du ihr mir mich uns euch was wo wer wann warum noch schon sehr bitte danke können möchte kein keine diese "
        "dieser dieses"
    ).split(),
    "fr": (
        "le la les un une des du de et ou mais dans sur pour avec par pas est sont que qui quoi dont nous vous ils elles être avoir cette ces son ses leur "
        "plus tout tous à au aux en y je tu il elle on me te se ne ce cet ma mon mes votre vos où quand comment pourquoi combien quel quelle quels quelles "
        "très aussi merci bonjour voudrais peux peut faut"
    ).split(),
    "es": (
        "el la los las un una unos unas de del en por para con sin que como donde cuando y o pero no es son está están ser estar este esta estos estas ese "
        "esa más todo todos a al lo le les se me te mi tu su sus yo él ella nos hay muy qué cuál cuánto cómo dónde quiero puedo puede tengo tiene gracias hola sí"
    ).split(),
    "pt": (
        "o a os as um uma uns umas de do da dos das em no na nos nas por para com sem que como quando e ou mas não é são ser estar este esta esse essa mais "
        "todo todos ao aos à às se me te meu minha seu sua eu ele ela você vocês muito qual quanto onde quero posso pode tenho tem obrigado obrigada olá sim"
    ).split(),
    "nl": (
        "de het een en of maar van voor met op in aan bij naar uit is zijn was niet ook als dat die dit deze wij zij je hebben heeft kan worden meer alle te "
        "er ik jij u we ze hij mij me ons jullie wat waar hoe wanneer waarom welke wel nog graag kunnen kunt wil moet bedankt hallo ja nee"
    ).split(),
}

# Phrases that mark an attempt to redirect the assistant.
INJECTION_MARKERS = [
    "ignore previous instructions", "ignore all previous", "ignore the above", "disregard", "system prompt", "you are now", "act as", "pretend you are",
    "pretend to be", "jailbreak", "dan mode", "developer mode", "do anything now", "ignora le istruzioni",
    "ignorez les instructions", "ignora las instrucciones", "ignoriere die anweisungen",
]

CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}"

# Marker words of languages in Latin script.
MARKERS = {
    "en": (
        "the and you your what where when why how can could would should have has does this that with please thanks hello which will about from are price "
        "cost shipping delivery return returns order product products available hours phone much many sell buy any"
    ).split(),
    "it": (
        "che di per sono questo questa come dove della delle nella degli anche ciao grazie prego vorrei posso avete quanto quale perché più cosa siamo è "
        "costa costano quanti quante quanta qual gli nel sul dal alla allo spedizione consegna reso resi prezzo prezzi ordine prodotto prodotti disponibile "
        "disponibili orari contatti telefono potete cerco buongiorno buonasera salve"
    ).split(),
    "de": (
        "der das und ich nicht ist sind wie wo wann kann können haben eine einen mit für auf aus bei nach wir ihr sie mir mich dieses diese dieser noch auch "
        "danke hallo bitte möchte gibt preis kostet kosten versand lieferung rückgabe bestellung produkt verfügbar öffnungszeiten kontakt telefon wieviel "
        "welche welcher habt dauert"
    ).split(),
    "fr": (
        "les une est et où vous nous pas pour avec dans sur comment quand bonjour merci être avoir cette votre aussi très voudrais ça quel quelle prix coûte "
        "combien livraison expédition commande produit produits horaires téléphone avez peux puis est-ce faut"
    ).split(),
    "es": (
        "el los las pero donde cuando hola gracias tengo quiero puedo tiene tienen usted cuánto cuál dónde cómo muy también aquí hay necesito ayuda algún sí "
        "precio cuesta cuestan envío devolución pedido producto productos horario teléfono tienes quisiera venden ustedes"
    ).split(),
    "pt": (
        "não você vocês obrigado obrigada olá onde quero tenho preciso gostaria muito também isso essa esse uma meu minha seu sua ele ela fazer pode qual é "
        "preço custa custam envio devolução produto produtos disponível horário telefone têm vendem quais"
    ).split(),
    "nl": (
        "het een niet ik jij wij jullie dat dit deze met voor van naar uit ook maar hoe waar wanneer kunnen hebben heeft zijn bedankt graag hoi prijs kost "
        "verzending levering bestelling beschikbaar openingstijden telefoon hoeveel kunt wilt verkopen"
    ).split(),
}


def raw_tokens(text: Column) -> Column:
    """All words of the lower-cased text in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def expand_cjk(tokens: Column) -> Column:
    """Words in CJK script become their character bigrams (a single character stays)."""

    def bigrams(w: Column) -> Column:
        two = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(2)))
        return F.when(w.rlike(f"[{CJK}]"), two).otherwise(F.array(w))

    return F.flatten(F.transform(tokens, bigrams))


def stem(token: Column, lang: Column) -> Column:
    """Strip the first suffix of the language's list that leaves four bytes at least."""

    def of(suffixes: list[str]) -> Column:
        cases = None
        for s in suffixes:
            fits = token.endswith(s) & (F.octet_length(token) - len(s.encode()) >= 4)
            cut = F.substring(token, F.lit(1), F.length(token) - len(s))
            cases = F.when(fits, cut) if cases is None else cases.when(fits, cut)
        return cases.otherwise(token)

    found = None
    for code, suffixes in SUFFIXES.items():
        found = F.when(lang == code, of(suffixes)) if found is None else found.when(lang == code, of(suffixes))
    return found.otherwise(token)


def index_words(text: Column, lang: Column, stop_words: dict[str, list[str]] | None = None) -> Column:
    """Words and CJK bigrams of 2 to 48 characters without the language's stop words, not yet stemmed."""
    stop = [f"{code} {w}" for code, words in (STOP_WORDS if stop_words is None else stop_words).items() for w in words]
    of = F.concat(F.coalesce(lang, F.lit("")), F.lit(" "))

    def kept(w: Column) -> Column:
        return (F.length(w) >= 2) & (F.length(w) <= 48) & ~F.concat(of, w).isin(stop)  # one look-up in a set, whatever the number of languages

    return F.filter(expand_cjk(raw_tokens(text)), kept)


def tokenize(text: Column, lang: Column, stop_words: dict[str, list[str]] | None = None) -> Column:
    """Index terms in order: ``index_words``, stemmed by language."""
    return F.transform(index_words(text, lang, stop_words), lambda w: stem(w, lang))


_WORDS = re.compile(TOKEN.replace(r"[\p{L}\p{N}]", r"[^\W_]"))  # the same characters
_HAS_CJK = re.compile("[" + re.sub(r"\\x\{(\w+)\}", r"\\u\1", CJK) + "]")


_MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())


class _Codes(dict):
    """What stands between white space to a number: that of its only term, -1 for none, -2 and less for several (a place in ``several``). Made where it is asked for."""

    def __init__(self, analysed):
        super().__init__()
        self.analysed, self.size, self.numbers, self.terms, self.several = analysed, 0, {}, [], []

    def number(self, term: str) -> int:
        n = self.numbers.get(term)
        if n is None:
            n = self.numbers[term] = len(self.terms)
            self.terms.append(term)
        return n

    def __missing__(self, piece: str) -> int:
        word = piece.strip(_MARKS)
        if word.isalnum() and len(word) < len(piece):
            code = self[word]
        else:
            terms = [self.number(term) for term in self.analysed(piece)]
            if len(terms) > 1:
                self.several.append(terms)
            code = terms[0] if len(terms) == 1 else -1 - bool(terms) * len(self.several)
        self[piece] = code
        self.size += len(piece) + 1
        return code


class TermCounts:
    """How often each term of ``tokenize`` is in a text that is lower-case already, for texts of one language in Arrow batches; terms in order of first use.

    No word holds white space, so texts are split there, and what stands between is analysed once, however often it comes: until over ``REMEMBERED`` such pieces or
    ``CHARACTERS`` of them are held, which is looked at before a text or a batch.
    """

    REMEMBERED, CHARACTERS = 200_000, 4_000_000

    def __init__(self, lang: str | None):
        self._suffixes = [(s, len(s), len(s.encode())) for s in SUFFIXES.get(lang, [])]
        self._ends = tuple(s for s, _, _ in self._suffixes)
        self._stop = frozenset(STOP_WORDS.get(lang, ()))
        self._codes = _Codes(self._analysed)

    def _stem(self, word: str) -> str:
        if not word.endswith(self._ends):
            return word
        size = len(word.encode())
        return next((word[:-n] for s, n, octets in self._suffixes if size - octets >= 4 and word.endswith(s)), word)

    def _terms(self, word: str) -> list[str]:
        parts = [word] if word.isascii() or not _HAS_CJK.search(word) else [word[i : i + 2] for i in range(max(len(word) - 1, 1))]
        return [self._stem(w) for w in parts if 2 <= len(w) <= 48 and w not in self._stop]

    def _analysed(self, piece: str) -> list[str]:
        if piece.isalnum():
            return self._terms(piece)
        return [term for word in _WORDS.findall(piece) for term in self._terms(word)]

    def _known(self) -> _Codes:
        if len(self._codes) > self.REMEMBERED or self._codes.size > self.CHARACTERS:
            self._codes = _Codes(self._analysed)
        return self._codes

    def __call__(self, text: str) -> dict[str, int]:
        found: dict[str, int] = {}
        known = self._known()
        for piece, n in Counter(text.split()).items():
            code = known[piece]
            for at in (code,) if code >= 0 else known.several[-2 - code] if code < -1 else ():
                found[known.terms[at]] = found.get(known.terms[at], 0) + n
        return found

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Of many texts at once: the places of texts, their terms, and how often each is there; a place and a term come once."""
        known = self._known()
        pieces = [text.split() for text in texts]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        codes = np.fromiter(map(known.__getitem__, chain.from_iterable(pieces)), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(pieces)), sizes)
        many = np.flatnonzero(codes < -1)
        lists = [known.several[-2 - code] for code in codes[many].tolist()]
        single = codes >= 0
        of = np.concatenate([of[single], np.repeat(of[many], [len(x) for x in lists])]) if lists else of[single]
        codes = np.concatenate([codes[single], np.fromiter(chain.from_iterable(lists), np.int64)]) if lists else codes[single]
        pairs, n = np.unique(of * max(len(known.terms), 1) + codes, return_counts=True)
        place, term = np.divmod(pairs, max(len(known.terms), 1))
        own, at = np.unique(term, return_inverse=True)
        return place, pa.array([known.terms[i] for i in own.tolist()], pa.string()).take(pa.array(at)), n


@lru_cache(maxsize=16)
def term_counts(lang: str | None) -> TermCounts:
    """``TermCounts`` of a language, one a process: later tasks find the words that earlier ones analysed."""
    return TermCounts(lang)


def words_of(text: Column, least: int = 2) -> Column:
    """Distinct lower-case words of ``least`` characters at least, in order of first use."""
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) >= least))


def normalize_message(text: Column, limit: int = 1000) -> Column:
    """Format and unassigned characters vanish, control characters become spaces, 1,000 characters at most."""
    text = F.regexp_replace(text, r"[\p{Cf}\p{Co}\p{Cn}]+", "")
    text = F.trim(F.regexp_replace(text, r"(?U)[\p{Cc}\s]+", " "))
    return F.substring(text, 1, limit)


def has_injection(text: Column) -> Column:
    lower = F.lower(text)
    return reduce(lambda a, b: a | b, (F.contains(lower, F.lit(m)) for m in INJECTION_MARKERS))


def question_hash(text: Column) -> Column:
    """Same question, same hash: lower case, one space for white space and punctuation."""
    clean = F.trim(F.lower(F.regexp_replace(text, r"[\s\p{P}]+", " ")))
    return F.when(F.length(clean) >= 3, F.sha1(clean.cast("binary")))


def error_fingerprint(kind: Column, agent: Column, task: Column, message: Column) -> Column:
    """Errors of one kind, agent and task that differ in numbers, paths and spacing only share a fingerprint."""
    salient = F.regexp_replace(F.regexp_replace(F.regexp_replace(message, "[0-9]+", "N"), r"/\S+", "/PATH"), r"\s+", " ")
    return F.sha1(F.concat_ws("|", kind, agent, F.coalesce(task, F.lit("-")), F.substring(F.lower(salient), 1, 160)).cast("binary"))


def canonical_url(url: Column, own_host: str | None = None) -> Column:
    """Without fragment, scheme and host in lower case, https for the own host, 2,048 characters at most."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    scheme = F.lower(F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    host = F.lower(F.regexp_extract(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?]*)", 1))
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?]*", "")
    if own_host:
        scheme = F.when(host == own_host, "https").otherwise(scheme)
    return F.substring(F.when(scheme == "", bare).otherwise(F.concat(scheme, F.lit("://"), host, rest)), 1, 2048)


def ip_network(ip: Column) -> Column:
    """The /24 of an IPv4 address, the /48 of an IPv6 address (short forms too), in lower case without leading zeros; null for what is neither."""
    groups = F.split(F.lower(F.trim(ip)), ":")
    head = F.split(F.split_part(F.lower(F.trim(ip)), F.lit("::"), F.lit(1)), ":")
    named = F.filter(F.when(F.contains(ip, F.lit("::")), head).otherwise(groups), lambda g: g != "")
    three = F.slice(F.concat(named, F.array_repeat(F.lit("0"), 3)), 1, 3)
    wide = F.concat(F.array_join(F.transform(three, lambda g: F.regexp_replace(g, "^0+(?=.)", "")), ":"), F.lit("::"))
    v4 = F.regexp_extract(F.trim(ip), r"^(\d{1,3}\.\d{1,3}\.\d{1,3})\.\d{1,3}$", 1)
    return F.when(v4 != "", F.concat(v4, F.lit(".0"))).when(F.trim(ip).rlike("(?i)^[0-9a-f:]*:[0-9a-f:.]*$"), wide)


def ip_hash(ip: Column, salt: Column) -> Column:
    """SHA-256 of an address's network and the salt in force; with a new salt, old hashes match nothing any more."""
    return F.sha2(F.concat(ip_network(ip), F.lit("|"), salt).cast("binary"), 256)


def domain(host: Column) -> Column:
    """Lower case, without www. and whatever a host name cannot hold."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r"^www\.", ""), r"[^a-z0-9.\-]", "")


def detect_language(text: Column, markers: dict[str, list[str]] | None = None) -> Column:
    """struct(lang, confidence): by script where a quarter of the letters share one, else by marker words.

    Texts under 15 characters stay undecided (''). Of languages with equal hits the first of ``markers`` wins.
    """
    # Script ranges, tested in this order after kana and Han.
    scripts = {
        "ko": r"\x{AC00}-\x{D7AF}\x{1100}-\x{11FF}", "ru": r"\x{0400}-\x{04FF}", "ar": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}",
        "el": r"\x{0370}-\x{03FF}", "he": r"\x{0590}-\x{05FF}", "hi": r"\x{0900}-\x{097F}",
    }
    markers = markers or MARKERS
    text = F.trim(text)
    letters = F.regexp_count(text, F.lit(r"\p{L}")).cast("double")
    share = lambda r: F.coalesce(F.try_divide(F.regexp_count(text, F.lit(f"[{r}]")), letters), F.lit(0.0))
    made = lambda lang, c: F.struct(lang.alias("lang"), c.cast("double").alias("confidence"))
    by_script = lambda lang, r: made(lang, F.round(F.least(F.lit(0.95), share(r) + 0.2), 2))
    kana, cjk = r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}", r"\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
    found = F.when(F.length(text) < 15, made(F.lit(""), F.lit(0.0)))
    found = found.when(share(cjk) >= 0.25, by_script(F.when(share(kana) > 0, "ja").otherwise("zh"), cjk))
    for lang, r in scripts.items():
        found = found.when(share(r) >= 0.25, by_script(F.lit(lang), r))
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))

    def one_of(words: list[str]):
        return lambda w: w.isin(words)

    def latin(found: Column) -> Column:  # (how many tokens, those that are a marker of any language)
        hits = F.array(
            *(
                F.struct(F.size(F.filter(found["marks"], one_of(words))).alias("hits"), F.lit(-i).alias("order"), F.lit(lang).alias("lang"))
                for i, (lang, words) in enumerate(markers.items())
            )
        )
        best = F.array_max(hits)
        ratio = F.coalesce(F.try_divide(best["hits"].cast("double"), found["n"]), F.lit(0.0))
        confidence = F.round(F.least(F.lit(0.95), ratio * 2.5, best["hits"] * F.lit(0.3)), 2)
        return F.when(best["hits"] > 0, made(best["lang"], confidence)).otherwise(made(F.lit(""), F.lit(0.0)))

    every = sorted(set().union(*markers.values()))
    counted = F.transform(F.array(tokens), lambda t: F.struct(F.size(t).alias("n"), F.filter(t, one_of(every)).alias("marks")))
    return found.otherwise(F.transform(counted, latin).getItem(0))


def luhn(digits: Column) -> Column:
    """Whether 13 to 19 digits have a valid check digit."""
    d = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x: x.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).when(x * 2 > 9, x * 2 - 9).otherwise(x * 2))
    valid = F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0
    return digits.rlike("^[0-9]{13,19}$") & F.when(digits.rlike("^[0-9]{13,19}$"), valid).otherwise(False)


def iban(code: Column) -> Column:
    """Whether a code is an IBAN by its form and its remainder by 97."""
    bare = F.upper(F.regexp_replace(code, r"\s+", ""))
    turned = F.concat(F.substring(bare, 5, 40), F.substring(bare, 1, 4))
    digits = F.filter(F.split(turned, ""), lambda x: x != "")
    value = lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda a, c: F.when(value(c) > 9, (a * 100 + value(c)) % 97).otherwise((a * 10 + value(c)) % 97)
    form = bare.rlike(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")
    return form & (F.aggregate(digits, F.lit(0), step) == 1)


# Words before the most and the least a visitor wants to pay.
AT_MOST = (
    r"(?:under|below|less\s+than|cheaper\s+than|max(?:imum)?|sotto(?:\s+i)?|meno\s+di|al\s+massimo|unter|weniger\s+als|h[öo]chstens|moins\s+de|maximum"
    r"|menos\s+de|como\s+m[áa]ximo|abaixo\s+de|minder\s+dan|maximaal)"
)
AT_LEAST = (
    r"(?:over|above|more\s+than|at\s+least|sopra(?:\s+i)?|pi[ùu]\s+di|almeno|[üu]ber|mehr\s+als|mindestens|plus\s+de|au\s+moins|m[áa]s\s+de|al\s+menos"
    r"|mais\s+de|pelo\s+menos|meer\s+dan|minstens)"
)


def price_bounds(text: Column) -> Column:
    """struct(min, max): the first number after words for the least and for the most; null where there is none."""

    def after(words: str) -> Column:
        found = F.regexp_extract(F.lower(text), rf"(?U)\b{words}\s*(?:[€$£]\s*)?(\d+(?:[.,]\d{{1,2}})?)", 1)
        return F.when(found != "", F.replace(found, F.lit(","), F.lit(".")).try_cast("double"))

    return F.struct(after(AT_LEAST).alias("min"), after(AT_MOST).alias("max"))


def skus(text: Column) -> Column:
    """Distinct codes of capitals and digits with a hyphen after two of them at least, and a letter somewhere."""
    codes = F.regexp_extract_all(text, F.lit(r"\b[A-Z0-9]{2,}-[A-Z0-9-]{2,}\b"), F.lit(0))
    return F.array_distinct(F.filter(codes, lambda c: c.rlike("[A-Z]")))


# Short names of commands.
COMMAND_ALIASES = {
    "kb.add": "kb.add_entry", "kb.new": "kb.add_entry", "kb.edit": "kb.update", "kb.remove": "kb.delete", "kb.trash": "kb.delete", "kb.undo": "kb.restore",
    "kb.ls": "kb.list", "kb.crawl": "kb.reindex", "stats.show": "stats.query", "memory.list": "memory.query", "memory.show": "memory.query",
}
_ARGUMENT = r"""(?i)([a-z_]+):(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)'|(\S+))"""


def slash_command(text: Column) -> Column:
    """struct(action, args, help) of ``/group verb key:value key:"a b" rest``; null for texts that do not start with a slash.

    Names are in lower case, hyphens of a verb are underscores, and short names stand for others. A value may be bare or in either kind of quotes, with
    backslash escapes in it; the last of a repeated key wins, and what follows the last pair (or all, without pairs) is ``_tail``. ``/help`` sets ``help``;
    a slash that no command follows has an empty action.
    """
    said = F.trim(text)
    form = r"(?is)^/([a-z]+)\s+([a-z\-_]+)\s*(.*)$"
    name = F.concat(F.lower(F.regexp_extract(said, form, 1)), F.lit("."), F.replace(F.lower(F.regexp_extract(said, form, 2)), F.lit("-"), F.lit("_")))
    aliases = F.create_map(*(F.lit(x) for pair in COMMAND_ALIASES.items() for x in pair))
    rest = F.trim(F.regexp_extract(said, form, 3))
    pairs = F.regexp_extract_all(rest, F.lit(_ARGUMENT), F.lit(0))

    def entry(pair: Column) -> Column:
        bare = F.regexp_extract(pair, _ARGUMENT, 4)
        quoted = F.concat(F.regexp_extract(pair, _ARGUMENT, 2), F.regexp_extract(pair, _ARGUMENT, 3))
        value = F.when(quoted != "", quoted).otherwise(bare)
        # a backslash goes; n, t, r, v, f after it stand for white space
        for letter, char in {"n": "\n", "t": "\t", "r": "\r", "v": "\v", "f": "\f"}.items():
            value = F.regexp_replace(value, rf"(?<!\\)((?:\\\\)*)\\{letter}", rf"$1{char}")
        return F.struct(F.lower(F.regexp_extract(pair, _ARGUMENT, 1)).alias("key"), F.regexp_replace(value, r"(?s)\\(.)", "$1").alias("value"))

    found = F.transform(pairs, entry)
    # the last of equal keys: the first when read backwards
    backwards = F.reverse(found)
    keys = F.transform(backwards, lambda e: e["key"])
    last = F.filter(backwards, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    cut = F.regexp_replace(rest, rf"(?s)^.*{_ARGUMENT}", "")
    tail = F.trim(F.when(F.size(pairs) > 0, cut).otherwise(rest))
    extra = F.when((tail != "") & ~F.array_contains(keys, F.lit("_tail")), F.array(F.struct(F.lit("_tail").alias("key"), tail.alias("value"))))
    args = F.map_from_entries(F.concat(F.reverse(last), F.coalesce(extra, F.array().cast("array<struct<key:string,value:string>>"))))
    none = F.map_from_entries(F.array().cast("array<struct<key:string,value:string>>"))
    asks_help, fits = said.rlike(r"(?i)^/help\b"), said.rlike(form)
    made = F.struct(
        F.when(fits & ~asks_help, F.coalesce(F.try_element_at(aliases, name), name)).otherwise("").alias("action"),
        F.when(fits & ~asks_help, args).otherwise(none).alias("args"),
        asks_help.alias("help"),
    )
    return F.when(F.startswith(said, F.lit("/")), made)


def citations(text: Column) -> Column:
    """Distinct numbers cited as [#n], in order; numbers beyond an int cite nothing."""
    found = F.regexp_extract_all(text, F.lit(r"\[#(\d+)\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.try_cast("int")), lambda n: n.isNotNull()))


def without_citations(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s*\[#\d+\]", ""), r"[ \t]{2,}", " "))


def excerpt(text: Column, title: Column, limit: int = 140, least: int = 60) -> Column:
    """Without a leading title, spaces collapsed, cut at the last space after ``least`` characters."""
    bare = F.when(F.startswith(text, title), F.substring(text, F.length(title) + 1, F.length(text))).otherwise(text)
    flat = F.trim(F.regexp_replace(bare, r"\s+", " "))
    head = F.substring(flat, 1, limit)
    space = F.length(head) - F.locate(" ", F.reverse(head))
    cut = F.when((F.locate(" ", F.reverse(head)) > 0) & (space > least), F.substring(head, F.lit(1), space)).otherwise(head)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(cut, F.lit("…")))


def _fact_lines(value, label: str = "") -> list[str]:
    """Leaves of nested facts as ``key sub: value``."""
    if isinstance(value, dict | list):
        items = value.items() if isinstance(value, dict) else enumerate(value)
        return [line for k, v in items for line in _fact_lines(v, f"{label} {k}" if label else str(k))]
    if value is None or value == "":
        return []
    return [f"{label}: {('yes' if value else 'no') if isinstance(value, bool) else value}"]


def flat_facts(facts: Column) -> Column:
    """JSON facts of any nesting as lines of text; null for null, nothing for a text that is no JSON object or array."""

    def flat(text):
        try:
            found = json.loads(text)
        except ValueError:
            return ""
        return "\n".join(_fact_lines(found)) if isinstance(found, dict | list) else ""

    def batch(texts: pd.Series) -> pd.Series:
        return texts.map(flat, na_action="ignore")

    return F.pandas_udf(batch, "string")(facts)


def luminance(color: Column) -> Column:
    """Relative luminance of #rrggbb (WCAG)."""

    def channel(at: int) -> Column:
        c = F.conv(F.substring(color, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return channel(2) * 0.2126 + channel(4) * 0.7152 + channel(6) * 0.0722
