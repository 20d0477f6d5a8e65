"""Template residue, filler text, error pages and script notices that stand where content should be.

Detectors over the whole text, outside fences and back-ticked spans (no shuffle):

* placeholders left unfilled, and forms whose sections hold only instructions;
* filler: a paragraph of which half the words are of the usual filler vocabulary, sentences with hardly any function word of a
  known language nor other short word, or a paragraph that says the same few words over and over.

Notice pages are found by comparing the address slug, the title and the body, and by what hosts give at other addresses:

* the lines of a text are sorted into navigation and footers (set aside, however many), a title, and prose. A text is
  *low in information* if its prose has at most ``FEW_TERMS`` different words. It is *mismatched* if its body has no term of its
  slug or title (a title alone: none of the slug); a single term that stands only in a line of a notice is no match.
* the wording of every line of prose of the mismatched, low-information texts is hashed, and the addresses that give it are
  counted by host and over all hosts (pre-aggregated). A wording that ``HOST_COPIES`` addresses of one host give, or
  ``ADDRESSES`` addresses of several hosts in different texts, is *stock*. A mismatched text is a notice if stock wordings are
  half of its prose and at most ``OTHER_WORDS`` words a line of stock are its own;
* at any length, a whole wording that ``HOST_COPIES`` mismatched slugs of one host give is a copied notice;
* where a corpus has no such repeats, detectors for lines of error, login, maintenance and script notices decide together with
  the mismatch: such a line, and no prose beside it but helper lines ("retry in 5 minutes") and ``OTHER_WORDS`` words.

Defined results. Null and empty texts are no case. A path without a term (null, or numbers only) cannot match, so the detectors
alone decide; a null host is a host of its own. Repeated rows give repeated results, which the query makes distinct, and
count as one address. Further columns are not read.
"""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.session import cut

CODE = re.compile(r"(?:^|(?<=\n))[ ]{0,3}(`{3,}|~{3,}).*?(?:\n[ ]{0,3}\1[`~]*[ \t\r]*(?=\n|\Z)|\Z)", re.S)
SPAN = re.compile(r"(?<!`)(`+)(?!`)[^\n]*?(?<!`)\1(?!`)")

#: Placeholders of template languages and of people.
PLACEHOLDERS = re.compile(
    "|".join(
        (
            r"\{\{[^{}\n]{1,80}\}\}",
            r"\{%[^%\n]{1,80}%\}",
            r"<%[^%\n]{1,80}%>",
            r"\$\{[^{}\n]{1,80}\}",
            r"\$\([A-Za-z][\w.\-]{0,60}\)",
            r"(?<![\w%])%[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+%(?![\w%])",
            r"<[A-Z][A-Z0-9]*(?:[_\-][A-Z0-9]+)+>",
            r"<<[A-Za-z][\w .\-]{0,60}>>",
            r"(?<!\w)__[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+__(?!\w)",
            r"@@[A-Za-z][\w.\-]{0,60}@@",
            r"\[(?:YOUR|INSERT)[ _][A-Z0-9 _\-]{1,60}\]",
            r"\[(?:[Ii]nsert|[Yy]our) [^\[\]\n]{1,60}\](?![(\[])",
            r"\b(?:Dear|Hello|Hi|Sehr geehrte[r]?|Hallo|Bonjour|Cher|Chère|Hola|Estimad[oa]) (?:\{[A-Za-z_][\w .\-]{0,40}\}|\[[A-Za-z][\w .\-]{0,40}\])(?![(\[])",
        )
    )
)
#: A text with none of these, nor two percent signs, has no placeholder.
_MARKS = ("{{", "{%", "<%", "${", "$(", "<", "__", "@@", "[YOUR", "[INSERT", "[Your", "[your", "[Insert", "[insert", "Dear ", "Hello ", "Hi ", "Sehr ", "Hallo ", "Bonjour ", "Cher", "Chère ", "Hola ", "Estimad")
#: A text with none of these has no line by which a form asks to be filled in.
_ASKS = ("TBD", "TODO", "tbd", "todo", "(to be ", "(fill in", "<short ", "<brief ", "<your ", "<one ", "<!--", "with your own", "before launch", "before publishing", " here", "\n_", "\n _", "\n\t_")
_BRACKET = re.compile(r"\[[A-Z][a-z]+[\] ]")
#: Lines by which a form asks to be filled in.
FORM = re.compile(
    "|".join(
        (
            r"(?<![\w\])])\[(?:[A-Z][a-z]+ ){0,2}(?:Title|Name|Date|Author|Summary|Company|Customer|Client|Address|Email|Phone|Product|Project|Recipient|Organi[sz]ation|Position|Amount|City|Country)\](?![(\[:])",
            r"\[(?:Describe|Explain|Add|Write|Fill in|List) [^\[\]\n]{1,80}\](?![(\[])",
            r"<(?:short|brief|your|one) [a-z][^<>\n]{1,80}>",
            r"\((?:to be (?:completed|defined|written|filled in|done|decided)|fill in[^()\n]{0,40})\)",
            r"^[ \t]*(?:TBD|TODO|tbd|todo)\.?[ \t\r]*$",
            r"^[ \t]*(?:TODO|TBD): [^\n]{1,80}",
            r"^[ \t]*_(?:Write|Describe|Explain|List|Add|Summari[sz]e) [^_\n]{1,100}_[ \t\r]*$",
            r"\b(?:[Rr]eplace|[Ii]nsert|[Ee]nter|[Tt]ype|[Aa]dd|[Pp]ut|[Ww]rite) (?:this|your|the|some) (?:\w+ )?(?:text|content|copy|description|title|name|summary|paragraph|message)\b[^.\n]{0,40}\b(?:here|with your own|before launch|before publishing)\b[^.\n]{0,40}",
            r"<!-- *(?:what|why|who|how|when|describe|explain|add|list)\b[^\n]{0,100}?-->",
        )
    ),
    re.M,
)
#: Function words of English, French, German and Spanish; a real paragraph has some. (fixed values)
FUNCTION_WORDS = frozenset(
    (
        "the a an of and to in is are was were be been that this these it its for on by with as at from not or but if when while because until "
        "before after than then so no any each every only both over into may must should will can has have had they their we our you your "
        "le la les l de des du un une et est sont au aux sur pour dans par qui que ne pas plus avec sans si ou ce cette ces il elle puis lorsque dès avant après "
        "der die das den dem des ein eine einer und oder ist sind von vom mit auf für im zu zum nach bei aus als wenn nicht durch über danach bevor sobald falls auch "
        "el los las del y o en se con una uno para por como su sus al es son sin si no luego tras hasta desde cuando aunque"
    ).split()
)
#: Words of the standard filler passage. (fixed values)
FILLER_WORDS = frozenset(
    (
        "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud "
        "exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur "
        "excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
    ).split()
)
#: Further words that generators of filler text use. (fixed values)
GENERATOR_WORDS = frozenset(
    (
        "accumsan aenean aliquam ante aptent arcu auctor augue bibendum blandit condimentum congue consequat conubia convallis cras cubilia curabitur curae cursus dapibus diam dictum "
        "dictumst dignissim donec dui efficitur egestas eget eleifend elementum erat eros etiam euismod facilisi facilisis fames faucibus felis fermentum feugiat finibus fringilla fusce "
        "gravida habitant habitasse hendrerit himenaeos iaculis imperdiet inceptos interdum justo lacinia lacus laoreet lectus leo libero ligula litora lobortis luctus maecenas magnis "
        "malesuada massa mattis mauris metus molestie mollis montes morbi nascetur natoque nec neque netus nibh nisl nostra nullam nunc odio orci ornare parturient pellentesque penatibus "
        "pharetra phasellus placerat platea porta porttitor posuere potenti praesent pretium primis proin pulvinar purus quam quisque rhoncus ridiculus risus rutrum sagittis sapien "
        "scelerisque sem semper senectus sociosqu sodales sollicitudin suscipit suspendisse taciti tellus tempus tincidunt torquent tortor tristique turpis ullamcorper ultrices ultricies "
        "urna varius vehicula vel venenatis vestibulum vitae vivamus viverra volutpat vulputate"
    ).split()
)
FILLER_VOCABULARY = FILLER_WORDS | GENERATOR_WORDS
_FILLER_ONLY = FILLER_VOCABULARY - FUNCTION_WORDS

_ERROR = re.compile(
    r"""
    ^(?:http\s*|error\s*|erreur\s*|fehler\s*|código\s*)?[45]\d\d\b
    | \b(?:not\ found|no\ such|could\ not\ be\ found|cannot\ be\ found|does\ not\ exist|no\ longer\ (?:exists|available|valid)|nothing\ here)\b
    | \b(?:page|site|space|repository|document|resource|project|workspace|account|link|content)\b.{0,40}\b(?:removed|moved|expired|archived|deleted|gone|closed|suspended|missing|unavailable|offline|private)\b
    | \b(?:forbidden|access\ (?:denied|refused|restricted)|entry\ (?:denied|refused)|permission\ (?:denied|refused)|not\ (?:allowed|permitted|authori[sz]ed)|unauthori[sz]ed)\b
    | \b(?:went\ wrong|an?\ (?:unexpected\ |internal\ )?(?:error|problem)\ (?:has\ )?occurred|hit\ a\ snag|did\ not\ work|internal\ server\ error|bad\ gateway|gateway\ timeout|upstream\ failure|service\ (?:temporarily\ )?unavailable)\b
    | \bslow\ down\b | \bcannot\ (?:load|render|display|open|process|fetch|find)\b | \b(?:unable|failed)\ to\ (?:load|render|display|open|process|fetch|complete|find)\b
    | \b(?:down\ for|under|undergoing)\ maintenance\b | \bbeing\ (?:upgraded|updated|repaired|moved)\b | \btemporarily\ (?:offline|unavailable|closed|down)\b
    | \b(?:too\ many\ requests|rate\ limit|request\ limit|quota\ exceeded)\b
    | \b(?:session|token|login|log-?in|sign-?in)\b.{0,20}\b(?:timed\ out|expired|ended|required)\b
    | \b(?:sign|log)\ in\b.{0,20}\b(?:to|before)\b | \byou\ (?:must|need\ to|have\ to)\ (?:sign|log)\ in\b
    | \b(?:checking|verify(?:ing)?|confirm)\b.{0,25}\b(?:human|visitor|person|robot|bot|browser)\b
    | \b(?:introuvable|no\ encontrad[oa]|nicht\ gefunden|ausente|existe\ (?:pas|plus)|(?:no|ya\ no)\ existe|nicht\ erreichbar|nicht\ mehr|inaccessible|existiert\ nicht|fehlt|absente?)\b
    | \b(?:accès|entrée|acceso|entrada)\b.{0,20}\b(?:refusée?|interdite?|prohibid[oa]|denegad[oa]|restringid[oa])\b | \bzugriff\b.{0,20}\b(?:verweigert|nicht\ erlaubt|gesperrt)\b
    | \bnon\ autorisée?\b | \bno\ (?:autorizad|permitid)[oa]\b | \bverboten\b
    | \berreur\b.{0,30}\b(?:survenue|produite)\b | \bha\ ocurrido\b.{0,30}\berror\b | \bse\ ha\ producido\b.{0,30}\berror\b | \bfehler\ aufgetreten\b | \bschiefgelaufen\b | \bsalió\ mal\b
    | \b(?:service|serveur|site|servicio|servidor|sitio|dienst|server|seite)\b.{0,30}\b(?:maintenance|mantenimiento|wartung|indisponible|no\ disponible|nicht\ verfügbar|momentan\w*)\b
    | \bseite\b.{0,30}\b(?:verschoben|entfernt|gelöscht)\b | \bpage\b.{0,30}\b(?:déplacée|supprimée)\b | \bpágina\b.{0,30}\b(?:movido|movida|eliminad[oa]|retirad[oa])\b
    | \b(?:trop\ de\ requêtes|demasiadas\ (?:solicitudes|peticiones)|zu\ viele\ anfragen)\b
    | \b(?:veuillez|merci\ de)\b.{0,20}\b(?:connecter|identifier)\b | \b(?:inicie|iniciar)\ sesión\b | \bbitte\b.{0,20}\b(?:anmelden|einloggen)\b | \bmelden\ sie\ sich\b | \bsitzung\b.{0,15}\babgelaufen\b | \bsesi(?:ón|on)\b.{0,20}\b(?:caducado|expirado|expirée?)\b
    """,
    re.X | re.I,
)
_SCRIPT = re.compile(
    r"""
    \b(?:enable|activate|allow|turn\ on|switch\ on|permit)\b.{0,30}\b(?:java\s?script|scripts?|scripting)\b
    | \b(?:java\s?script|scripts?|scripting)\b.{0,40}\b(?:required|needed|disabled|blocked|enabled?|switched\ off|turned\ off|off|must)\b
    | \b(?:requires?|needs?|relies\ on|depends\ on|works\ (?:best|only)\ with|without)\b.{0,25}\b(?:java\s?script|scripts?|scripting)\b
    | \bbrowser\b.{0,40}\b(?:not\ supported|unsupported|too\ old|outdated|out\ of\ date|no\ longer\ supported|scripting|scripts?)\b
    | \b(?:activer|autoriser|activez|autorisez)\b.{0,25}\b(?:java\s?script|scripts?)\b
    | \b(?:active|habilite|activar|habilitar|permita|permitir)\b.{0,25}\b(?:java\s?script|scripts?)\b
    | \b(?:java\s?script|skripte?|scripts?)\b.{0,60}\b(?:aktivieren|einschalten|erlauben|zulassen|nécessaire|necesari[oa]|erforderlich|benötigt|desactivad[oa]|désactivée?|deaktiviert)\b
    | \b(?:aktivieren|erlauben|benötigt|erfordert|nécessite|necesita|requiere)\b.{0,25}\b(?:java\s?script|skripte?|scripts?)\b
    """,
    re.X | re.I,
)
_HELP = re.compile(
    r"""
    \b(?:retry\ (?:in|after|later|now)|try\ again|come\ back|check\ back)\b | \b(?:switch|turn)\ (?:it|them)\ on\b | \bto\ continue\b | \b(?:request|incident|reference|trace|ray|error)\b\ ?(?:id|code|number)?:?\ [0-9a-f\-]{6,}\b | \bquote\ [0-9a-f]{6,}\b
    | \b(?:contact|write\ to|ask)\ (?:the\ |your\ |us|our\ )(?:administrator|help\ desk|support|team|owner)? | \bdid\ not\ (?:answer|respond)\b
    | \btyped\ the\ address\b | \bcheck\ the\ (?:address|url|link|spelling)\b | \b(?:go\ back|return|back)\b.{0,20}\b(?:home|start|index|page)\b | ^return\ home$ | ^go\ back$
    | \brefresh\b.{0,15}\bpage\b | \benable\ it\b | \bbrowser\ settings\b | \breload\b
    | \b(?:réessayez|reintente|inténtelo|versuchen\ sie)\b | \bzurück\ zur\b | \bretour\ à\b | \bvolver\ a\b
    """,
    re.X | re.I,
)
_FOOTER = re.compile(r"^\s*(?:©|\(c\)|copyright\b)", re.I)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
_JSON = re.compile(r'^\s*\{\s*"(?:status|error|code|message)"\s*:.*\}\s*$', re.S)
#: One or more sentences of at least five words in Latin letters.
_SENTENCES = re.compile(r"[A-ZÀ-Þ][a-zß-ÿ]+(?:,?\s+[A-Za-zÀ-ÿ]+){4,}[.!?](?:\s+[A-ZÀ-Þ][a-zß-ÿ]+(?:,?\s+[A-Za-zÀ-ÿ]+){2,}[.!?])*")

#: Different words of prose that a text low in information has at most.
FEW_TERMS = 80
#: Words of prose that a notice page may have beside its title and the lines of a notice.
OTHER_WORDS = 6
#: Words of a line of a notice that a detector looks at.
NOTICE_WORDS = 16
#: Addresses of one host that give the same wording before it counts.
HOST_COPIES = 3
#: Addresses of at least two hosts that give the same wording, in as many different texts, before it counts.
ADDRESSES = 5
#: Parts of addresses that say nothing about a page.
GENERIC = frozenset("docs doc index readme default main home page pages html htm php asp aspx txt rst adoc mdx".split())
#: A paragraph of no known language has at most one function word in so many words, and one of three letters or less.
RARE = 12


def address_terms(path: str) -> tuple[str, set[str]]:
    """The last part of a path that says something, and its terms; ('', no terms) if no part does."""
    for part in reversed(re.split(r"[/\\]", path)):
        terms = {x for x in re.split(r"[\W\d_]+", part.lower()) if len(x) > 2} - GENERIC
        if terms:
            return part, terms
    return "", set()


def _has_word(text: str, word: str) -> bool:
    """Whether a word of letters stands in a text as a whole word."""
    at = text.find(word)
    while at >= 0:
        end = at + len(word)
        if not (at and text[at - 1].isalpha()) and not (end < len(text) and text[end].isalpha()):
            return True
        at = text.find(word, at + 1)
    return False


def unmatched(text: str, path: str) -> tuple[str, str]:
    """(slug, text without its address) where neither title nor body has a term of the slug, else ('', ''); of any length.

    The address itself, if the page repeats it, and navigation do not count as title or body.
    """
    slug, terms = address_terms(path)
    if not terms:
        return "", ""
    text = text.replace(path, "#")
    low = text.lower()
    if any(x in low for x in terms):
        body = "\n".join(x for x in low.split("\n") if "|" not in x)
        if any(_has_word(body, x) for x in terms):
            return "", ""
    return slug, text


def _wordings(texts: list[str]) -> list[str]:
    """Digests of the wordings: numbers, capitalised words and white space aside."""
    masked = pc.replace_substring_regex(pa.array(texts, pa.string()), r"\b[0-9a-f]{6,}\b|[0-9]+|\b[A-Z]\w+", "#")
    plain = pc.utf8_trim_whitespace(pc.replace_substring_regex(masked, r"\s+", " "))
    return [hashlib.blake2b(x.encode("utf-8", "replace"), digest_size=16).hexdigest() for x in plain.to_pylist()]


_ID = re.compile(r"\b[0-9a-f]{6,}\b|\d+")
_LEAD = re.compile(r"^[#>*+\-\s]+|[*_]{1,2}")
_SEPARATOR = re.compile("[|·›»]")
_LINK = re.compile(r"!?\[([^\[\]]*)\]\([^()]*\)")
_STATUS = re.compile(r'"(?:status|code)"\s*:\s*"?[45]\d\d')
_HARD = re.compile(r"[0-9a-f]{8}|\b\d+ (?:seconds|minutes)|address|administrator|help desk")


def _navigation(plain: str, n: int) -> bool:
    """Whether a line is a row of links or names: separators, or capitalised words without a full stop."""
    if "|" in plain or " · " in plain or " › " in plain or " » " in plain:
        return n <= 3 * (1 + sum(plain.count(c) for c in "|·›»")) and not plain.endswith((".", "!", "?"))
    return n <= 8 and not plain.endswith((".", ":", ";", ",", "!", "?")) and len(w := plain.split()) >= 3 and all(x[:1].isupper() for x in w)


def low_lines(text: str) -> list[tuple[str, str, list[str]]] | None:
    """(line, its plain form, its words) of the sentences and titles of a text low in information; None for others."""
    long: list[str] = []
    for line in text.split("\n"):
        if len(line) > 150 and not _SEPARATOR.search(line) and line.count(" ") > 30 and not _FOOTER.match(line):
            long.append(line)
            if len(set(" ".join(long).lower().split())) > FEW_TERMS and len(set(_WORD.findall(" ".join(long).lower()))) > FEW_TERMS:
                return None
    lines, few = [], set()
    for line in _SENTENCE.split(text):
        line = line.strip()
        if "](" in line:
            line = _LINK.sub(r"\1", line)
        low = _WORD.findall(line.lower())
        n = len(low)
        plain = _LEAD.sub("", line).strip()
        if (n or any(c.isdigit() for c in plain)) and not _FOOTER.match(plain) and not _navigation(plain, n):
            lines.append((line, plain, low))
            few.update(low)
            if len(few) > FEW_TERMS:
                return None
    return lines


def _loose(rx: re.Pattern) -> str:
    """A pattern for the vectorised engine that matches wherever ``rx`` does: without word boundaries and layout."""
    return "(?i)" + re.sub(r"\s+", "", rx.pattern.replace("\\ ", "\0")).replace("\0", " ").replace(r"\b", "")


_MAY = None


def _may_say(plain: list[str]) -> list[bool]:
    """Whether one of the detectors may match a line."""
    global _MAY
    _MAY = _MAY or "|".join(f"(?:{_loose(rx)})" for rx in (_ERROR, _SCRIPT, _HELP))
    return pc.match_substring_regex(pa.array(plain, pa.string()), _MAY).to_pylist()


def judged(lines: list[tuple[str, str, list[str]]], may: list[bool], slug_terms: set[str]) -> tuple[bool, bool, int, list[tuple[int, int]]]:
    """(mismatched, detected, other, wordings) of the lines of a text."""
    other = notices = hard = 0
    title, body, said, wordings = "", set(), set(), []
    for (line, plain, low), maybe in zip(lines, may):
        n = len(low)
        if maybe and n <= NOTICE_WORDS and (_ERROR.search(plain) or _SCRIPT.search(plain)):
            notices += 1
            said.update(low)
        elif maybe and n <= NOTICE_WORDS + 6 and _HELP.search(plain):
            hard += bool(_HARD.search(plain))
            said.update(low)
        elif not title and (line.startswith("#") or not wordings):
            title = plain
        else:
            other += n
            body.update(low)
        wordings.append((_digest(_ID.sub("#", plain.lower())), n))
    heading = {x for x in _WORD.findall(title.lower()) if len(x) > 2} - FUNCTION_WORDS
    match = (slug_terms | heading) & body or len((slug_terms | heading) & said) > 1 or heading & slug_terms and not said and not body
    detected = bool(notices and other <= OTHER_WORDS or hard and other + len(_WORD.findall(title)) <= 2 * OTHER_WORDS)
    return not match, detected, other, wordings


def _payload(text: str, terms: set[str]) -> bool | None:
    """Whether a text that is an error as JSON is mismatched; None for other texts."""
    if _JSON.match(text) and (_ERROR.search(text) or _STATUS.search(text)):
        return len(terms & set(_WORD.findall(text.lower()))) < 2
    return None


def evidence(text: str, path: str) -> tuple[str, bool, bool, int, list[tuple[int, int]]] | None:
    """(slug, mismatched, detected, other, wordings) of a text low in information, None for others.

    ``detected`` is whether detectors see a notice and no more than helper lines and ``other`` words of prose beside it; the
    wordings are (hash, words) of the lines of prose.
    """
    slug, terms = address_terms(path)
    if (payload := _payload(text, terms)) is not None:
        return slug, payload, True, 0, []
    lines = low_lines(text)
    return (slug, *judged(lines, _may_say([x[1] for x in lines]), terms)) if lines else None


def _digest(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _low(words: list[str]) -> bool:
    """Whether a paragraph says the same few words over and over."""
    return len(words) >= 9 and len(few := set(words)) * 3 <= len(words) and len(few) <= 8


def _filler(paragraph: str) -> bool:
    words = _WORD.findall(paragraph.lower())
    if not _SEPARATOR.search(paragraph) and (_low(words) or words and _low(paragraph.lower().split())):
        return True
    if len(words) < 5:
        return False
    if len(_FILLER_ONLY.intersection(words)) >= 3 and 2 * sum(w in FILLER_VOCABULARY for w in words) >= len(words):
        return True
    return _unknown(paragraph, words)


def _unknown(paragraph: str, words: list[str]) -> bool:
    """Whether a paragraph has the form of sentences, but hardly any function words of a known language nor other short words.

    Every language written in Latin letters has many short words; lists, tables and enumerations are not sentences.
    """
    plain = re.sub(r"^(?:#+ [^\n]*\n|[ \t]*[>*+\-] )+", "", paragraph, flags=re.M).strip()
    if not _SENTENCES.fullmatch(plain) or plain.count(",") * 3 > len(words):
        return False
    return RARE * sum(w in FUNCTION_WORDS for w in words) <= len(words) and RARE * sum(len(w) <= 3 for w in words) <= len(words)


def prose(text: str) -> str:
    """The text without fences and back-ticked spans."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = CODE.sub("\n", text)
    return SPAN.sub(" ", text) if "`" in text else text


def residue_kind(text: str) -> str | None:
    """'placeholder', 'form' or 'filler' if the text has such residue outside code."""
    plain = None
    if any(m in text for m in _MARKS) or text.count("%") > 1:
        plain = prose(text)
        if PLACEHOLDERS.search(plain):
            return "placeholder"
    if (any(m in text for m in _ASKS) or "[" in text and _BRACKET.search(text)) and len(FORM.findall(plain := plain or prose(text))) >= 2:
        return "form"
    if any(map(_suspect, re.split(r"\n[ \t\r]*\n", text))):
        plain = plain or prose(text)
        if any(_suspect(x) and (_filler(x) or _dots(x)) for x in re.split(r"\n[ \t]*\n", plain)):
            return "filler"
    return None


def _suspect(paragraph: str) -> bool:
    """Whether a paragraph repeats itself or may be in no known language; cheaper than ``_filler``, and true wherever that is."""
    words = paragraph.split()
    return len(words) >= 5 and (len(words) >= 9 and len(set(words)) * 2 <= len(words) or _odd(paragraph))


def _odd(paragraph: str) -> bool:
    """Whether a paragraph may be filler: words of the passage, or few function words."""
    low = paragraph.lower()
    for stop in ".,;:!?":
        low = low.replace(stop, " ")
    words = low.split()
    return sum(map(FUNCTION_WORDS.__contains__, words)) * RARE <= len(words) or len(_FILLER_ONLY.intersection(words)) >= 3


def _dots(paragraph: str) -> bool:
    """Whether a paragraph is a long row of dots."""
    words = paragraph.split()
    return len(words) >= 9 and set(words) <= {"...", "…", "..", "."}


_CANDIDATE = "kind string, slug string, whole string, wordings array<struct<h: bigint, n: int>>"
_UNITS = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())]))


def _kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole_batch in batches:
        for start in range(0, whole_batch.num_rows, 2000):
            batch = whole_batch.slice(start, 2000)
            found: dict[int, list] = {}
            pages, copies = [], []
            for i, (path, text) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if kind := residue_kind(text):
                    found[i] = [kind, None, None, None]
                    continue
                slug, terms = address_terms(path or "")
                payload = _payload(text, terms)
                if payload:
                    found[i] = ["notice", None, None, None]
                    continue
                if payload is None and (lines := low_lines(text)):
                    pages.append((i, slug, terms, lines))
                if path and (same := unmatched(text, path))[0]:
                    copies.append((i, *same))
            may = iter(_may_say([x[1] for _, _, _, lines in pages for x in lines]))
            for i, slug, terms, lines in pages:
                mismatched, detected, _, wordings = judged(lines, [next(may) for _ in lines], terms)
                if mismatched and (slug or detected):
                    found[i] = ["notice" if detected else "page", slug or None, None, [{"h": h, "n": n} for h, n in wordings] if slug else None]
            for (i, slug, _), digest in zip(copies, _wordings([x[2] for x in copies])):
                if i not in found:
                    found[i] = ["long", slug, digest, None]
                elif found[i][0] == "page":
                    found[i][2] = digest
            at = sorted(found)
            rows = batch.take(pa.array(at, pa.int64()))
            columns = [pa.array([found[i][k] for i in at], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), _UNITS))]
            yield pa.RecordBatch.from_arrays([*rows.columns[:2], *columns], ["doc", "host", "kind", "slug", "whole", "wordings"])


def residue(df: DataFrame, doc: str, text: str, path: str, host: str) -> DataFrame:
    """(doc, kind): kind is 'placeholder', 'form', 'filler', 'notice', 'stock notice' or 'copied notice'."""
    rows = df.select(F.col(doc).alias("doc"), F.col(host).alias("host"), F.col(path).alias("path"), F.col(text).alias("text")).where("text IS NOT NULL AND text <> ''")
    pages = cut(rows.mapInArrow(_kinds, f"doc {dict(rows.dtypes)['doc']}, host string, {_CANDIDATE}"))

    # whole wordings that several slugs of one host give
    whole = pages.where("whole IS NOT NULL").select("doc", "host", "slug", "whole")
    copies = whole.select("host", "whole", "slug").distinct().groupBy("host", "whole").agg(F.count("*").alias("n")).where(F.col("n") >= HOST_COPIES)
    copied = whole.alias("w").join(copies.alias("c"), F.col("w.host").eqNullSafe(F.col("c.host")) & (F.col("w.whole") == F.col("c.whole")), "left_semi")

    # wordings of lines, by host and over all hosts; a text counts for its own lines only with other texts beside it
    body = F.xxhash64("wordings.h")
    lines = pages.where("wordings IS NOT NULL").select("doc", "host", "slug", body.alias("body"), F.explode("wordings").alias("w")).select("doc", "host", "slug", "body", "w.h", "w.n")
    by_host = lines.select("h", "host", "slug", "body").distinct().groupBy("h", "host").agg(F.count_distinct("slug").alias("slugs"), F.count_distinct("body").alias("bodies"))
    stock = by_host.groupBy("h").agg(F.max("slugs").alias("most"), F.sum("slugs").alias("slugs"), F.sum("bodies").alias("bodies"), F.count("*").alias("hosts"))
    stock = stock.where((F.col("most") >= HOST_COPIES) & (F.col("bodies") >= HOST_COPIES) | (F.col("slugs") >= ADDRESSES) & (F.col("bodies") >= ADDRESSES) & (F.col("hosts") > 1)).select("h", F.lit(1).alias("stock"))
    judged = lines.join(stock, "h", "left").groupBy("doc").agg(F.sum(F.col("n") * F.coalesce("stock", F.lit(0))).alias("in_stock"), F.sum("n").alias("n"), F.count("stock").alias("lines"))
    repeated = judged.where((2 * F.col("in_stock") >= F.col("n")) & (F.col("n") - F.col("in_stock") <= OTHER_WORDS * F.col("lines")))

    sure = pages.where("kind NOT IN ('page', 'long')").select("doc", "kind")
    return sure.union(repeated.select("doc", F.lit("stock notice"))).union(copied.select("doc", F.lit("copied notice")))
