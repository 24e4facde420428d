"""Template residue, filler and error pages among texts (problem 8)."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from operator import eq

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pointloom.llm.texts import _UNSEEN, without_markup
from pointloom.operators.skew import join_by_weight
from pointloom.operators.staging import stage

#: A line of a host is recurrent from so many documents on that are also this part of the host's, and boilerplate if in this part of such documents, at least, real content stands beside it.
RECURRENT, SHARE, BESIDE = 5, 0.005, 0.3
#: How sure the part must be: standard errors of the lower bound that is compared.
SURE = 1.96
#: Words that make a line real content; twice as many letters of a script that doesn't part words.
CONTENT_WORDS = 12
#: Furniture lines of all hosts that are broadcast, as numbers of eight bytes.
MAX_LINES = 2_000_000

# --- what is only spoken of: code and quotations -------------------------------------------------
_FENCED = regex.compile(r"(```|~~~).*?(?:\1|\Z)|<(pre|code)\b[^>]*>.*?(?:</\2\s*>|\Z)", regex.S | regex.I)
_OPEN_FENCE = regex.compile(r"\A\s*(?:```|~~~)[^\n]*\n(?!.*(?:```|~~~))", regex.S)
_TICKED = regex.compile(r"`[^`\n]{1,400}`")
_QUOTED = regex.compile(r"\"(?:[^\"\n]|\n(?!\s*\n)){1,400}\"|“[^”\n]{1,400}”|„[^“”\n]{1,400}[“”]|«[^»\n«]{1,400}»|「[^」\n]{1,400}」|『[^』\n]{1,400}』|(?<![\w])'[^'\n]{1,400}'(?![\w])")
_SPOKEN = regex.compile(r"\"[^\"]{1,400}\"")

# --- slots that were never filled ----------------------------------------------------------------
_NAME = r"[A-Za-z][\w .|'-]{0,60}?"
_SLOTS = [
    r"\{\{[^{}\n]{0,100}\}\}",  # {{ name }}
    r"\{%[^%\n]{1,100}%\}",  # {% block %}
    r"<%[=-]?[^%\n]{1,100}%>",  # <%= name %>
    r"[$#]\{[^{}\n]{1,100}\}",  # ${NAME} #{name}
    r"@@\w{1,60}@@",
    r"%\([A-Za-z]\w{0,60}\)[sdrf]",
    r"(?<![\w%])%[A-Z][A-Z0-9_]{1,60}%(?![\w%])",
    r"(?<![\w$])\$[A-Z][A-Z0-9_]{1,60}\$(?![\w$])",
    rf"\[\[\s*{_NAME}\s*\]\]",
    rf"<<\s*{_NAME}\s*>>",
    r"(?<![\w])__[A-Z][A-Z0-9_]{0,60}?__(?![\w])",
    r"(?<![\\\w}^_{])\{(?:[A-Za-z_][\w.]{1,60}|[A-Za-z](?=:))(?::[^{}\n]{0,20})?\}",  # {name} {name:.3f}, but no {x} and nothing that a formula puts in braces
    r"(?i:\[\s*(?:insert|enter|add|your|name of|fill in)\b[^\[\]\n]{0,80}\])",
    r"(?i:<\s*(?:insert|enter|your)\b[^<>\n]{0,80}>)",
    r"(?i:[<\[({][^<>\[\](){}\n]{1,80}\b(?:goes? here|to be (?:filled in|added|supplied|completed)|here)[>\])}])",
    r"(?<![\w\]])\[(?!Note|Info|Warn|Error|Debug|Edit|Sic|Trace|Fatal)[A-Z][a-z]+(?: [A-Za-z][a-z]*){0,3}\](?![(:\w])",  # [Reviewer]
    r"\[object Object\]",
    r"(?<![\w])X{4,}(?![\w])",
    r"(?<=[^\s_] ?)(?<![\w])_{4,}(?![\w])|(?<![\w])_{4,}(?![\w])(?= ?[^\s_])",
]
_SLOT = regex.compile("|".join(_SLOTS))
_PERCENT, _CLOSED = re.compile(r"%[A-Z(]"), re.compile(r"(?:here|filled in|added|supplied|completed)\)", re.I)
_SLOT_PLAIN = regex.compile(r"\[object object\]|(?<![\w])x{4,}(?![\w])")

# --- fixed values: what servers, walls and editors say, in plain form without case ----------------
_REASONS = (
    "bad request|unauthori[sz]ed|payment required|forbidden|not found|method not allowed|not acceptable|request timeout|conflict|gone|"
    "payload too large|unsupported media type|unprocessable entity|locked|too many requests|unavailable for legal reasons|"
    "internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|insufficient storage"
)
_SCRIPT = r"(?:java ?script|js|scripts?|scripting|cookies)"
_SCRIPTS = rf"(?:the )?{_SCRIPT}(?:(?:,| and| or| &) {_SCRIPT})*"
#: Reasons that are also plain words: they count where they are a line by themselves or follow their number.
_PLAIN_REASONS = "conflict|gone|locked|unauthori[sz]ed|forbidden|not found|not acceptable|not implemented"
_SORRY = r"(?:(?:we(?: are|.re) |i.m )?(?:very |so |terribly )?sorry[,.!:–—-]* (?:but |about that[,.!:]* )?)?"
_LACKS = r"(?:(?:was|were|is|are|can|could|has|does|cannot|can.t|couldn.t|isn.t|wasn.t|doesn.t)(?: not)?(?: be| been)? ?(?:found|located|available|accessible|reached|loaded|displayed|exist|moved|removed|deleted|denied|blocked|refused))"
_ERRORS = [
    # a status line or a page that is one
    rf"(?:http/\d(?:\.\d)?\s+)?[45]\d\d\s*[-:–—|]?\s*(?:{_REASONS})\b",
    r"http (?:status|error)(?: code)?:?\s*[45]\d\d\b",
    r"[45]\d\d\s*[-:–—|]\s*[\w ,'’]{0,60}\b(?:not found|error|denied|forbidden|unavailable|unauthori[sz]ed|bad request|time-?d? ?out|gateway|refused|exceeded|too many|not allowed)\b[^.!?]{0,20}(?:$|[.!])",
    rf"(?!(?:{_PLAIN_REASONS})(?: \(|\s*(?:$|[.!])))(?:{_REASONS})(?: \([45]\d\d\))?\s*(?:$|[.!])",
    rf"(?:{_PLAIN_REASONS}) \([45]\d\d\)\s*(?:$|[.!])",
    r"(?:error|erreur|fehler|errore|erro|błąd|ошибка|fout|오류|エラー)(?: code)? ?[45]\d\d ?(?:[:：.]|$)",
    r"(?:the |this |that )?(?:page|content|resource|document|file|article)(?: that)? (?:you (?:asked|are looking|were looking|requested)(?: for)? )?(?:was |could |can ?)?not (?:be )?found\b",
    rf"(?:the |this |that )?requested (?:url|uri|page|resource|file|document|address|content)\b[^.!?]{{0,80}}? {_LACKS}",
    r"(?:oops|whoops|uh-oh)(?:\s*(?:$|[!.…,:–—-]+\s*$)|[!.…,:–—-]*\s*(?:(?:something|that page|this page|the page|we (?:can|could|were|are|hit|ran|have|broke)|it (?:looks|seems)|looks like|page|an? (?:unexpected )?error|there (?:was|is|has)|sorry|nothing|your )))",
    rf"{_SORRY}(?:but )?something (?:has gone|went|is) (?:terribly |horribly )?wrong\b",
    r"access (?:was |is )?denied\s*(?:$|[.!])",
    r"your (?:ip )?address has been blocked",
    r"sorry[,.!:]* (?:this|the|that) (?:page|content|site) (?:isn.?t|is not|is no longer) available", r"your session has (?:expired|timed out)",
    r"upstream connect error",
    r"you have (?:reached|exceeded) (?:the|your) (?:\w+ )?(?:limit|quota)",
    r"too many requests",
    r"(?:the )?connection (?:has )?(?:timed out|was reset)",
    r"(?:we are|we.re|the (?:site|service|server) is|this site is) (?:currently )?(?:down|offline|closed) for (?:scheduled |planned )?maintenance",
    r"application error: a (?:server|client).side exception",
    r"the request could not be completed",
    rf"{_SORRY}an? (?:unexpected |internal |unknown )?(?:server )?error (?:has )?occurred",
    r"this (?:site|page) can.?t be reached",
    r"you (?:do(?: not|n.?t) have|lack) (?:the )?permissions? to (?:view|access)",
    rf"{_SORRY}(?:we|the server) (?:can.?t|cannot|can not|could ?n.?t|could not|were unable to|are unable to|was unable to) (?:find|locate|load|display|complete|process) (?:the|that|this|your) (?:page|request|resource|content|file)",
    r"(?:la )?page (?:demandée )?(?:est )?introuvable",
    r"seite (?:wurde )?nicht gefunden",
    r"(?:no se encontró la )?página (?:solicitada )?no (?:se ha )?encontrada",
    r"no se encontró la página",
    r"zugriff verweigert",
    r"accès (?:refusé|interdit)",
    r"acceso denegado",
    r"ページが見つかりません",
    r"アクセスが拒否",
    r"页面未找到|找不到页面|抱歉，您访问的页面不存在|您访问的页面",
    r"(?:запрашиваемая |запрошенная )?страница не (?:найдена|существует)",
    r"доступ (?:запрещ[её]н|закрыт)",
    r"что-то пошло не так",
    r"произошла (?:внутренняя )?ошибка",
    r"(?:nie znaleziono (?:takiej )?strony|(?:podana |szukana )?strona nie (?:została znaleziona|istnieje))",
    r"(?:odmowa dostępu|brak dostępu|dostęp zabroniony)",
    r"coś poszło nie tak",
    r"wystąpił (?:nieoczekiwany )?błąd",
    r"(?:de )?(?:opgevraagde )?pagina (?:is |werd |kon )?niet (?:worden )?gevonden",
    r"toegang (?:geweigerd|verboden)",
    r"er is iets (?:mis|fout|verkeerd) ?gegaan",
    r"er is een (?:onverwachte )?fout opgetreden",
    r"(?:요청하신 )?페이지를 찾을 수 없습니다",
    r"접근이 (?:거부|차단)",
    r"(?:알 수 없는 )?오류가 발생했습니다",
    r"(?:la )?pagina (?:richiesta )?non (?:è stata )?trovata",
    r"accesso negato",
    r"qualcosa è andato storto",
    r"página não (?:foi )?encontrada",
    r"acesso negado",
    r"algo deu errado",
    r"une erreur (?:inattendue )?(?:est survenue|s.est produite)",
    r"(?:ein|es ist ein) (?:unerwarteter )?fehler (?:ist )?aufgetreten",
    r"etwas ist schiefgelaufen",
    r"(?:se ha producido|ocurrió) un error",
    r"algo salió mal",
]
_WALLS = [
    rf"(?:you (?:need|have) to |you must |kindly |please |to [\w ]{{3,40}}, (?:please )?)?(?:enable|turn on|switch on|activate|allow|unblock) {_SCRIPTS}\b",
    rf"(?:this|our|the|your) [\w ]{{2,40}}?(?:requires?|needs?) (?:a browser with |you to (?:enable|allow) |that )?{_SCRIPTS}\b",
    rf"(?:this|our|the|your) [\w ]{{2,40}}?(?:does not|doesn.?t|will not|won.?t|cannot|can.?t) (?:work|run|load|function|be shown|be displayed) (?:properly |correctly )?(?:without|unless) {_SCRIPTS}\b",
    rf"(?:please |you (?:need|have) to |kindly )?(?:turn|switch) {_SCRIPTS} (?:back )?on\b",
    rf"without {_SCRIPTS}[, ]+(?:enabled |turned on |switched on )?(?:this|our|the) [\w ]{{2,40}}(?:does not|doesn.?t|will not|won.?t|cannot|can.?t)\b",
    rf"{_SCRIPTS} (?:is|are|must be|needs? to be|has to be|have to be|seems? to be) (?:required|needed|necessary|disabled|blocked|switched off|turned off|enabled|allowed|switched on|turned on)\b",
    r"your browser (?:has|does not|doesn.?t) (?:it (?:switched|turned) off|support (?:java ?script|scripts))",
    r"allow them for this site",
    r"checking your browser before",
    r"(?:veuillez |merci d.)?(?:activer|activez|autorisez|autoriser) (?:java ?script|les (?:scripts|cookies))",
    r"java ?script (?:est|doit être) (?:requis|nécessaire|désactivé|activé)",
    r"(?:cette|notre|ce) [\w ]{2,30} (?:nécessite|requiert|exige) (?:java ?script|des scripts)",
    r"(?:bitte )?(?:aktivieren|erlauben|schalten) sie (?:java ?script|skripte|cookies)",
    r"(?:diese|unsere|dieser|unser) [\w ]{2,30}(?:benötigt|erfordert|braucht) (?:java ?script|skripte|scripts)",
    r"(?:por favor,? )?(?:active|activa|habilite|habilita) (?:java ?script|los scripts|las cookies)",
    r"(?:esta|este|nuestra|nuestro) [\w ]{2,30} (?:requiere|necesita) (?:java ?script|scripts)",
    r"(?:пожалуйста,? )?включите (?:поддержку )?java ?script",
    r"для (?:работы|просмотра|корректной работы) [^.!?]{0,40}(?:необходим|требуется|нужен|включите) java ?script",
    r"(?:proszę )?włącz(?:yć)? (?:obsługę )?java ?script",
    r"ta (?:strona|witryna) wymaga (?:obsługi )?java ?script",
    r"(?:schakel|zet) java ?script (?:in|aan)",
    r"deze (?:site|website|pagina) (?:vereist|heeft) java ?script",
    r"(?:이 페이지를 보려면 )?(?:자바스크립트|java ?script)를 (?:활성화|사용|켜)",
    r"(?:ative|habilite) o? ?java ?script",
    r"(?:per favore )?(?:abilita|attiva) java ?script",
    r"[^。]{0,30}(?:java ?script|スクリプト|クッキー)を有効に",
    r"请(?:启用|开启) ?java ?script",
]
_FILLERS = [
    r"lorem\b", r"this is (?:a |some )?(?:placeholder|dummy|filler|sample) text", r"replace (?:it|this|me)(?: text)? with your (?:own )?\w+",
    r"(?:your|the) (?:\w+ ){1,2}(?:goes|go|will appear|appears) here",
    r"sample (?:heading|title|paragraph|text)(?: sample|\s*[.!]|\s*$)",
    r"type your \w+ here",
    r"(?:insert|add|write|enter) (?:\w+ ){0,5}(?:sentences?|introduction|paragraphs?|description|summary|text|title)(?: about [\w ]{1,30}| in this [\w ]{1,20}| here| below)\s*(?:$|[.!])",
    r"votre \w+ (?:apparaîtra|ira|va|viendra) ici",
    r"(?:texte|contenu) (?:de remplissage|fictif|provisoire)",
    r"(?:ihr|ihre|der|die|dein|deine) \w+ (?:steht|erscheint|kommt) hier",
    r"hier (?:steht|erscheint|folgt|kommt) (?:(?:später|bald|noch|demnächst) )*(?:ihr|ihre|der|die|das|dein|ein|eine)\b",
    r"(?:\w+ )?(?:überschrift|titel|text|beschreibung|zusammenfassung) (?:hier )?(?:einfügen|eingeben|ergänzen)",
    r"(?:bitte )?vor (?:dem veröffentlichen|der veröffentlichung) (?:ersetzen|ausfüllen)",
    r"(?:dies ist (?:ein )?)?(?:platzhalter|blindtext|fülltext)",
    r"(?:su|tu|aquí (?:va|irá) (?:su|tu|el|la)) \w+ (?:aparecerá|irá|va) aquí",
    r"aquí (?:va|irá|aparecerá) (?:su|tu|el|la) ",
    r"(?:\w+ )?à (?:remplacer|compléter|remplir)(?: avant (?:la )?publication)?\s*(?:$|[.!])",
    r"(?:escriba|inserte|introduzca|añada) (?:aquí )?(?:un|una|el|la|su) (?:título|texto|descripción|resumen)",
    r"(?:reemplazar|sustituir|reemplace|sustituya) antes de publicar",
    r"replace (?:\w+ )?before (?:you )?publish(?:ing|ed)?",
    r"(?:это )?текст[- ](?:заполнитель|рыба|заглушка)",
    r"здесь (?:будет|появится|должен быть) (?:ваш |ваша )?(?:текст|описание|заголовок)",
    r"(?:tutaj|tu) (?:będzie|pojawi się|wpisz) (?:twój |swój )?(?:tekst|opis|tytuł)",
    r"(?:tekst|treść) zastępcz[ya]",
    r"hier komt (?:de|uw|je|jouw|een) (?:tekst|titel|beschrijving)",
    r"(?:dit is )?(?:voorbeeldtekst|opvultekst)",
    r"여기에 [^.!?]{0,20}(?:입력|작성)",
    r"(?:testo|contenuto) (?:segnaposto|di esempio)",
    r"(?:este é um )?texto de (?:exemplo|preenchimento)",
    r"(?:este es un )?texto de (?:relleno|ejemplo|muestra)", r"ここに[^。]{0,20}(?:入力|記入|表示|入り|書いて)", r"(?:これは)?(?:ダミー|サンプル|仮の?)テキスト",
]
#: Tried at every sentence: the standard engine is the faster one for many alternatives.
_START_RE = re.compile(r"[-*>#•\s]*(?:" + "|".join("(" + "|".join(part) + ")" for part in (_ERRORS, _WALLS, _FILLERS)) + ")")
_BREAK = re.compile(r"(?<=[.!?…|»›])\s+|(?<=[。！？])")
_BODY = regex.compile(r"(?:^|(?<=\s))\{\s*\"(?:error|errors|status|code|message|detail|fault)\"\s*:[^\n]{0,200}?\"?(?:error|message|code|detail|reason)\"?", regex.M | regex.I)
#: Syllables of which invented Latin is made; a stretch of words of nothing else is filler. So is one of words from one row of keys.
_SYLLABLES = "a ad al am as at bo bor bus ci co cil con cu cul da dam des di dit do dolor du dunt e ea ed ei el em en enim er es est et eu eum ex fer fu gi gna i id il im in ing ip ipsum ir is isc it ius la lab lam li lit lla lo lor lorem ma mag me men met mi min mod mol na nal ni nim nis nos nul o off oc om or os pa par per pro qua que qui quis re rem ri ru se sec sed si sint sit su sum sus ta te tem tem tetur ti tion to tra trud tum tur ul um un ur ut va vel ven vo vol"
_LATIN = regex.compile("(?:" + "|".join(sorted(_SYLLABLES.split(), key=len, reverse=True)) + ")+")
_KEYS = regex.compile(r"[asdfghjklöä;]{2,}|[qwertyuiop]{3,}|[zxcvbnm]{2,}")
LATIN_WORDS, KEY_WORDS = 10, 6
#: A phrase of up to so many words that follows itself so often is filler.
PHRASE, AGAIN = 4, 4
#: Letters of an exclamation that people do repeat (no, ha, so), and how often none does.
INTERJECTION, OFTEN = 3, 7
_EMPTY = r"(?:todo|tbd|tba|fixme(?:: ?write this)?|n/a|coming soon|to be (?:written|added|done|announced)|under construction|section left blank|(?:this )?(?:section|page) (?:is )?(?:intentionally )?(?:left )?blank|write this|placeholder|untitled|à compléter|folgt|in arbeit|por completar|準備中)"
_EMPTY_LINE = regex.compile(rf"[\s\-*•#>.]*{_EMPTY}[\s.!:…-]*")
_NOTHING = regex.compile(rf"(?:[\s\-*•#>.,;:|/]*{_EMPTY}[\s\-*•#>.,;:|/!…]*)+")
_BROKEN = regex.compile(r"[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u0178\u0192\u02c6\u02dc\u2013-\u2122]{1,3}")


_BLOCK_TAG = regex.compile(r"</?(?:p|div|li|h\d|br|title|body|html|head|noscript|td|tr)\b[^<>]*>", regex.I)
_PLAIN_LINE = re.compile(rf"(?:{_PLAIN_REASONS})\s*[.!]?")


def _may_hold_slot(t: str) -> bool:
    """Whether a text has a sign that every slot has one of; most texts have none."""
    if "{" in t or "[" in t or "<" in t or "$" in t or "@@" in t or "__" in t or "XXXX" in t:
        return True
    return bool("%" in t and _PERCENT.search(t) or ")" in t and _CLOSED.search(t))


def _mended(text: str) -> str:
    """`text` with UTF-8 that was read as a single-byte encoding read again."""

    def again(m: regex.Match) -> str:
        raw = bytearray()
        for c in m[0]:
            try:
                raw += c.encode("cp1252")
            except UnicodeEncodeError:
                if ord(c) > 255:
                    return m[0]
                raw.append(ord(c))
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return m[0]

    return _BROKEN.sub(again, text)


_kinds: dict[str, int] = {}


def _is_repeated(words: list[str]) -> bool:
    """Whether a text has a phrase of more than an interjection that follows itself again and again."""
    for p in range(1, PHRASE + 1):
        if sum(map(eq, words, words[p:])) >= AGAIN * p:
            run = 0
            for at, same in enumerate(map(eq, words, words[p:])):
                run = run + 1 if same else 0
                if run >= AGAIN * p and (run >= OFTEN * p or len("".join(words[at : at + p])) > INTERJECTION):
                    return True
    return False


def _kind(word: str) -> int:
    """1: a word of invented Latin, 2: one typed on a row of keys, 3: both, 0: neither."""
    bare = word.strip(".,;:!?")
    return (1 if _LATIN.fullmatch(bare) else 0) | (2 if _KEYS.fullmatch(bare) else 0) if len(bare) <= 64 else 0


_STRETCH = re.compile(rb"[\x01\x03]{%d}|[\x02\x03]{%d}" % (LATIN_WORDS, KEY_WORDS))


def _is_invented(words: list[str]) -> bool:
    """Whether a text has a stretch of invented Latin or of words typed on one row of keys."""
    try:
        kinds = bytes(map(_kinds.__getitem__, words))
    except KeyError:
        if len(_kinds) > 300_000:
            _kinds.clear()
        for word in words:
            if word not in _kinds:
                _kinds[word] = _kind(word)
        kinds = bytes(map(_kinds.__getitem__, words))
    return _STRETCH.search(kinds) is not None


def _needed(sequence) -> frozenset[str] | None:
    """Literals of which every match of a parsed pattern holds one, as long as can be; None if it needs none."""
    best, run = None, ""

    def offer(found: frozenset[str] | None) -> None:
        nonlocal best
        if found and (best is None or min(map(len, found)) > min(map(len, best))):
            best = found

    for op, held in [*sequence, (None, None)]:
        if str(op) == "LITERAL":
            run += chr(held)
            continue
        if run:
            offer(frozenset([run]))
            run = ""
        if str(op) == "BRANCH":
            each = [_needed(b) for b in held[1]]
            offer(frozenset().union(*each) if all(each) else None)
        elif str(op) == "SUBPATTERN":
            offer(_needed(held[-1]))
        elif str(op) in ("MAX_REPEAT", "MIN_REPEAT") and held[0] > 0:
            offer(_needed(held[2]))
    return best


def _sign() -> ahocorasick.Automaton | None:
    """Finds what every error, notice or filler has one of, whatever its pattern; None if a pattern has no such literal."""
    found = ahocorasick.Automaton()
    for pattern in (*_ERRORS, *_WALLS, *_FILLERS):
        literals = _needed(re._parser.parse(pattern))
        if not literals:
            return None
        for word in literals:
            found.add_word(word, True)
    found.make_automaton()
    return found


_SIGN = _sign()


def _has_sign(text: str) -> bool:
    return _SIGN is None or next(_SIGN.iter(text), None) is not None


def evidence(text: str) -> str | None:
    """What shows that content is missing in a text: 'slot', 'error', 'filler', 'script' or 'empty', or None.

    Code and quotations only speak of things and are left out; what remains counts
    where it stands as a message of its own, at the start of a line or sentence.
    """
    text = _mended(text) if not text.isascii() else text
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _UNSEEN.sub("", text))
    told = _FENCED.sub("\n", text) if "```" in text or "~~~" in text or "<" in text else text
    if not told.strip():  # a fence that opens a text and never closes holds all of it: then it is no quotation
        told = _OPEN_FENCE.sub("\n", text)
    if "`" in told:
        told = _TICKED.sub(" ", told)
    if "{" in told and _BODY.search(told):
        return "error"
    if not told.isascii() or '"' in told or "'" in told:
        told = _QUOTED.sub(" ", told)
    if _may_hold_slot(told) and _SLOT.search(told):
        return "slot"
    if "<" in told:
        told = _BLOCK_TAG.sub("\n", told)
    shown = without_markup(told).casefold()
    if ("xxxx" in shown or "[" in shown) and _SLOT_PLAIN.search(shown):
        return "slot"
    lines = [" ".join(x.split()) for x in shown.splitlines()]
    lines = [x for x in lines if x]
    joined = " ".join(lines)
    if '"' in joined:
        joined = _SPOKEN.sub(" ", joined)
    signs = [x for x in lines if _has_sign(x)]
    sentences = [s for x in signs for s in _BREAK.split(x)]
    if len(lines) > 1 and (signs or _has_sign(joined)):  # those that run over the end of a line
        known = set(sentences)
        sentences += [s for s in _BREAK.split(joined) if s not in known]
    for sentence in sentences:
        if _has_sign(sentence) and (m := _START_RE.match(sentence)):
            return next(name for name, group in zip(("error", "script", "filler"), m.groups(), strict=True) if group is not None)
    if any(_PLAIN_LINE.fullmatch(x) for x in lines if len(x) < 20):
        return "error"
    if _is_repeated(joined.replace(",", "").replace(".", "").replace(";", "").split()) or _is_invented(joined.split()):
        return "filler"
    if any(_EMPTY_LINE.fullmatch(x) and x != "n/a" for x in lines) or (lines and _NOTHING.fullmatch(" ".join(lines))):
        return "empty"
    return None


def _line_keys(text: Column) -> Column:
    """The lines of a text in the form in which they are counted: no case, white space as single blanks, none at the ends."""
    small = F.lower(text)
    single = F.when(small.rlike(r"[\t\x0B\f\r]|  "), F.regexp_replace(small, r"[ \t\x0B\f\r]+", " ")).otherwise(small)
    return F.transform(F.split(single, "\n"), lambda x: F.trim(x))


def boilerplate_lines(docs: DataFrame, text: str, host: str, recurrent: int = RECURRENT, beside: float = BESIDE, share: float = SHARE) -> DataFrame:
    """(`host`, `line`: hash of the normalised line): what a host puts around its content.

    A line counts once a document. It is boilerplate if `recurrent` or more documents
    of the host, and `share` or more of them all, have it and the part with another line of real content is `beside` or
    more by the lower bound of its Wilson interval; so a message that stands for the
    content is none, however often a host repeats it. Lines without a letter are not counted. Null is a host of its own.
    """
    lines = F.transform(F.array_distinct(_line_keys(F.col(text))), lambda x: F.struct(x.alias("key"), _is_content(x).cast("int").alias("real")))
    held = docs.where(F.col(text).isNotNull()).select(F.col(host).alias("host"), lines.alias("lines"))
    counted = held.withColumn("content", F.aggregate("lines", F.lit(0), lambda n, x: n + x["real"]))
    each = counted.select("host", "content", F.explode("lines").alias("at")).where(F.col("at.key").rlike(r"\p{L}"))
    other = F.when(F.col("content") > F.col("at.real"), 1).otherwise(0)
    sums = each.groupBy("host", F.xxhash64("at.key").alias("line")).agg(F.count(F.lit(1)).alias("n"), F.sum(other).alias("amid"))
    n, part, z = F.col("n").cast("double"), F.col("amid") / F.col("n"), SURE
    surely = (part + z * z / (2 * n) - z * F.sqrt(part * (1 - part) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    whole = held.groupBy(F.col("host").alias("of")).agg(F.count(F.lit(1)).alias("docs"))
    usual = sums.where((n >= recurrent) & (surely >= beside))
    return usual.join(whole, usual["host"].eqNullSafe(whole["of"])).where(n >= share * F.col("docs")).select("host", "line")


def _is_content(key: Column) -> Column:
    """Whether a line has the words of real content, or as much in a script that doesn't part words."""
    words = F.length(key) - F.length(F.replace(key, F.lit(" "))) + 1
    dense = F.length(F.regexp_replace(key, r"[^\u0e00-\u0e7f\u3040-\u30ff\u3400-\u9fff]", ""))
    long = F.length(key) >= 2 * CONTENT_WORDS - 1  # shorter ones have neither
    return long & ((words >= CONTENT_WORDS) | ((F.octet_length(key) > 1.8 * F.length(key)) & (dense >= 2 * CONTENT_WORDS)))


def find_residue(docs: DataFrame, doc: str, text: str, host: str, recurrent: int = RECURRENT, beside: float = BESIDE, max_lines: int = MAX_LINES) -> DataFrame:
    """(`doc`, `evidence`): documents in which a slot, filler, an error message or a notice that scripts are needed stands where content should.

    Lines are counted by host over all documents; what recurs as furniture is
    subtracted from the host's texts, but for lines that themselves show a slot, filler
    or an error, and what is left is searched whole. The lines of all hosts are
    broadcast if they are `max_lines` at most; more are joined by host, hosts with many
    documents by broadcast and the others by a shuffle. Null and blank texts show
    nothing; repeated documents are reported row by row.
    """
    kind = docs.schema[doc].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around: dict[str, bool] = {}

        def is_furniture(line: str) -> bool:
            found = around.get(line)
            if found is None:
                if len(around) > 100_000:
                    around.clear()
                found = around[line] = evidence(line) in (None, "script")
            return found

        for batch in batches:
            shown = []
            for raw, usual in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                t = raw.as_py().decode("utf-8", errors="replace")
                if usual:
                    lines, places = t.split("\n"), set(usual)
                    t = "\n".join(x for i, x in enumerate(lines) if i not in places or not is_furniture(x))
                shown.append(evidence(t))
            kept = pa.array([i for i, e in enumerate(shown) if e], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), pa.array([e for e in shown if e], type=pa.string())], names=[doc, "evidence"])

    usual = boilerplate_lines(docs, text, host, recurrent, beside)
    around = stage(usual.groupBy("host").agg(F.sort_array(F.collect_list("line")).alias("lines")), "furniture")
    size = around.agg(F.count(F.lit(1)).alias("hosts"), F.sum(F.size("lines")).alias("lines")).first()
    plain = docs.where(F.col(text).isNotNull()).select(F.col(doc).alias("doc"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    if not size["hosts"]:
        held = plain.withColumn("lines", F.lit(None).cast("array<bigint>"))
    elif size["hosts"] + size["lines"] <= max_lines:
        of = around.withColumnRenamed("host", "of")
        held = plain.join(F.broadcast(of), plain["host"].eqNullSafe(of["of"]), "left")
    else:
        count = plain.groupBy("host").agg(F.count(F.lit(1)).alias("weight"))
        known = count.join(around.withColumnRenamed("host", "of"), F.col("host").eqNullSafe(F.col("of")), "left").drop("of")
        held = join_by_weight(plain, stage(known, "hosts"), ["host"], "weight", plain.count())
    places = F.array_compact(F.transform(_line_keys(F.col("text")), lambda x, i: F.when(F.array_contains("lines", F.xxhash64(x)), i)))
    marked = held.select("doc", F.col("text").cast("binary").alias("text"), F.when(F.col("lines").isNotNull(), places).alias("usual"))
    return marked.mapInArrow(search, f"`{doc}` {kind}, evidence string")
