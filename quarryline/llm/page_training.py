"""Labelled pages from which the page model is trained.

The pages are made by rules: a layout family (semantic tags, named boxes, anonymous boxes, layout tables, old unclosed markup,
a flat body, several posts, a manual with a list of contents) is drawn at random, and so are the nesting, the order of the
parts, names out of lists that are common on the web or without meaning, the level of the headline (h1, a lower heading, or
none), and what stands around and inside the article. Texts are in four languages; every piece of text knows whether it
belongs to the article. ``pages`` gives the same pages for the same seed; their number is the documented bound of the
training sample. No page, name or sentence is taken from fetched pages.
"""

import random
import re

#: Labelled pages by default.
PAGES = 2400

# Words from which texts are put together; what they say does not matter. (fixed values)
_WORDS = {
    "en": "the a this each no of for with when until after before and but report system team index value table store line page build change record order test cache queue result update check reads writes keeps moves sends finds ten small new old slow ready".split(),
    "fr": "le la un une les des pour avec quand après avant et mais rapport système équipe index valeur table ligne page version dossier ordre essai file résultat lit écrit garde envoie trouve petit nouveau lent prêt sans".split(),
    "de": "der die das ein eine für mit wenn nach vor und aber Bericht System Gruppe Index Wert Tabelle Zeile Seite Stand Ordnung Probe Schlange Ergebnis liest schreibt behält sendet findet klein neu langsam bereit ohne".split(),
    "es": "el la un una los las para con cuando antes después y pero informe sistema equipo índice valor tabla línea página versión orden prueba cola resultado lee escribe guarda envía encuentra pequeño nuevo lento listo sin".split(),
}
_MENU = {
    "en": "Home Docs Blog About Pricing Support Contact Login Search Jobs Status".split(),
    "fr": "Accueil Docs Journal Tarifs Aide Contact Connexion Statut Recherche".split(),
    "de": "Start Doku Blog Preise Hilfe Kontakt Anmelden Status Suche".split(),
    "es": "Inicio Documentos Blog Precios Ayuda Contacto Entrar Estado Buscar".split(),
}
_COOKIE = {
    "en": ["We use cookies to measure visits.", "This site stores files on your device. Choose what you allow.", "By using this site you accept our policy."],
    "fr": ["Ce site utilise des cookies pour mesurer l'audience.", "En poursuivant, vous acceptez notre politique."],
    "de": ["Diese Seite verwendet Cookies, um Zugriffe zu messen.", "Mit der Nutzung stimmen Sie der Speicherung zu."],
    "es": ["Este sitio utiliza cookies para medir las visitas.", "Al continuar acepta nuestra política."],
}
_RIGHTS = {"en": "All rights reserved.", "fr": "Tous droits réservés.", "de": "Alle Rechte vorbehalten.", "es": "Todos los derechos reservados."}
_LEGAL = {"en": "Terms · Privacy · Imprint", "fr": "Mentions légales · Confidentialité", "de": "Impressum · Datenschutz", "es": "Aviso legal · Privacidad"}
_AGREE = {"en": ["Accept all", "Reject", "Settings"], "fr": ["Tout accepter", "Refuser"], "de": ["Alle akzeptieren", "Ablehnen"], "es": ["Aceptar todo", "Rechazar"]}
_MORE = {"en": ["More pages", "Related", "In this section", "See also"], "fr": ["Voir aussi", "À lire"], "de": ["Mehr dazu", "Siehe auch"], "es": ["Más páginas", "Ver también"]}

#: Marks around text of the article while a page is put together.
ON, OFF = "\x02", "\x03"

# Names of boxes that are common on the web. (fixed values)
_NAMES = {
    "main": "content main-content post post-content entry entry-content article article-body story page-content doc docs markdown prose hentry text body-text".split(),
    "nav": "nav navbar menu main-menu site-nav topnav header-nav tabs navigation toolbar".split(),
    "crumb": "breadcrumb breadcrumbs trail path you-are-here".split(),
    "side": "sidebar side aside widget widget-area related related-posts more secondary right-col left-col complementary".split(),
    "foot": "footer site-footer foot colophon legal copyright bottom imprint".split(),
    "cookie": "cookie cookie-bar cookie-notice consent gdpr modal overlay popup banner notice dialog".split(),
    "share": "share sharing social social-links follow-us tools actions".split(),
    "promo": "newsletter signup subscribe promo teaser cta box widget".split(),
    "wrap": "wrap wrapper container page row columns layout grid inner site outer".split(),
    "meta": "meta byline toc outline on-this-page".split(),
}
_ENABLE = ("Please enable JavaScript.", "This site needs JavaScript to work.", "Veuillez activer JavaScript.", "Bitte JavaScript einschalten.", "Active JavaScript, por favor.")


class _Page:
    def __init__(self, r: random.Random):
        self.r, self.lang = r, r.choice(("en", "en", "fr", "de", "es"))
        self.upper = False

    def words(self, low: int, high: int) -> str:
        w = [self.r.choice(_WORDS[self.lang]) for _ in range(self.r.randint(low, high))]
        return " ".join(w).capitalize()

    def title(self) -> str:
        return self.words(3, 8)

    def sentence(self) -> str:
        return self.words(7, 20) + self.r.choice("...!") + ""

    def prose(self, low: int = 1, high: int = 5, mark: bool = True) -> str:
        text = " ".join(self.sentence() for _ in range(self.r.randint(low, high)))
        if self.r.random() < 0.6:
            w = text.split()
            for _ in range(self.r.randint(0, 3)):
                k, tag = self.r.randrange(len(w)), self.r.choice(("em", "strong", "code", "a"))
                w[k] = f"<{tag}{' href=' + chr(34) + '/x' + chr(34) if tag == 'a' else ''}>{w[k]}</{tag}>"
            text = " ".join(w)
        return ON + text + OFF if mark else text

    def part(self, level: int, close: bool) -> str:
        """What may stand in an article beside prose."""
        r, kind = self.r, self.r.random()
        mark = lambda t: f"{ON}{t}{OFF}"
        end = lambda tag: f"</{tag}>" if close else ""
        if kind < 0.35:
            return f"<p>{self.prose()}{end('p')}"
        if kind < 0.55:
            tag = r.choice(("ul", "ul", "ol"))
            link = lambda t: f'<a href="/{r.randrange(99)}">{t}</a>' if r.random() < 0.15 else t
            return f"<{tag}>" + "\n".join(f"<li>{mark(link(self.sentence() if r.random() < 0.5 else self.title()))}{end('li')}" for _ in range(r.randint(1, 7))) + f"</{tag}>"
        if kind < 0.68:
            head = "<tr>" + "".join(f"<th>{mark(self.words(1, 2))}{end('th')}" for _ in range(3)) + "</tr>" if r.random() < 0.5 else ""
            rows = "".join("<tr>" + "".join(f"<td>{mark(r.choice((self.words(1, 2), str(r.randint(1, 999)), self.title())))}{end('td')}" for _ in range(3)) + end("tr") for _ in range(r.randint(1, 6)))
            return f"<table>{head}{rows}</table>"
        if kind < 0.80:
            code = "\n".join(f"{r.choice(_WORDS['en'])} --{r.choice(_WORDS['en'])} {r.randint(1, 99)}" for _ in range(r.randint(1, 4)))
            return r.choice((f"<pre>{mark(code)}</pre>", f"<pre><code>{mark(code)}</code></pre>", f"<div><pre>{mark(code)}</pre></div>"))
        if kind < 0.86:
            return f"<blockquote><p>{self.prose(1, 2)}{end('p')}</blockquote>"
        if kind < 0.90:
            return "<dl>" + "".join(f"<dt>{mark(self.words(1, 3))}{end('dt')}<dd>{self.prose(1, 2)}{end('dd')}" for _ in range(r.randint(1, 4))) + "</dl>"
        if kind < 0.94:
            return f'<figure><img src="/x.png"><figcaption>{self.prose(1, 1)}</figcaption></figure>'
        return f"<div>{self.prose(1, 3)}</div>"

    def article(self) -> str:
        r, out = self.r, []
        close = r.random() < 0.8
        par = lambda: f"<p>{self.prose()}" + ("</p>" if close or r.random() < 0.7 else "")
        level = r.choices((1, 2, 3, 0), (62, 16, 4, 18))[0]
        if level:
            head = f"<h{level}>{ON}{self.title()}{OFF}</h{level}>"
            out.append(f"<header>{head}</header>" if r.random() < 0.04 else head)
        for _ in range(r.choice((0, 1, 1, 2, 2, 3)) + (0 if level else r.choice((1, 2, 3)))):
            out.append(par())
        for _ in range(r.choice((0, 1, 2, 3, 4)) if level or r.random() < 0.3 else 0):
            name = ON + r.choice((self.title(), self.words(1, 2), f"{r.randint(0, 9)}.{r.randint(0, 40)}.{r.randint(0, 9)}")) + OFF
            name = f'<a href="/{r.randrange(99)}">{name}</a>' if r.random() < 0.12 else name
            section = [f"<h{level + 1 if level else 2}>{name}</h{level + 1 if level else 2}>"]
            section += [self.part(level, close) for _ in range(r.choice((1, 1, 2, 3)))]
            if r.random() < 0.1:
                section.append(f"<h{level + 2 if level else 3}>{ON}{self.title()}{OFF}</h{level + 2 if level else 3}>{par()}")
            joined = "\n".join(section)
            wrap = r.random()
            out.append(f"<section>{joined}</section>" if wrap < 0.12 else f"<div{self.name('wrap')}>{joined}</div>" if wrap < 0.2 else joined)
        return "\n".join(out)

    def links(self, low: int, high: int, long: bool = False) -> str:
        n, r = self.r.randint(low, high), self.r
        item = (lambda: self.title()) if long else (lambda: r.choice(_MENU[self.lang]))
        style = r.random()
        if not long and style < 0.35:
            return r.choice((" | ", " · ", " ")).join(f'<a href="/{k}">{item()}</a>' for k in range(n))
        plain = not long and style > 0.8
        return "<ul>" + "".join(f"<li>{item()}</li>" if plain else f'<li><a href="/{k}">{item()}</a></li>' for k in range(n)) + "</ul>"

    def side(self) -> str:
        r, out = self.r, []
        if r.random() < 0.5:
            out.append(f"<{(t := r.choice(('h4', 'b', 'h3')))}>{r.choice((r.choice(_MORE[self.lang]), self.words(1, 3)))}</{t}>")
        out.append(self.links(2, 8, long=True))
        if r.random() < 0.5:
            p = self.prose(1, 2, mark=False)
            out.insert(r.choice((0, len(out))), r.choice((f"<p>{p}</p>", f"<hr>{p}", f"<div>{p}</div>")))
        return "".join(out)

    def foot(self) -> str:
        r = self.r
        name = self.words(1, 2).title()
        year = r.choice((f"{r.randint(1996, 2026)}", f"{r.randint(1996, 2010)}-{r.randint(2011, 2026)}"))
        parts = [r.choice((f"© {year} {name}. {_RIGHTS[self.lang]}", f"© {year} {name}. {_RIGHTS[self.lang]}", f"Copyright {year} {name}", f"Copyright {year} {name}. {_RIGHTS[self.lang]}", f"{name}, {year}"))]
        if r.random() < 0.6:
            parts.append(self.sentence())
        parts.append(_LEGAL[self.lang])
        if r.random() < 0.5:
            parts.append(self.sentence())
        kind = r.random()
        if kind < 0.5:
            return "".join(f"<p>{p}</p>" for p in parts)
        return f"<small>{' '.join(parts)}</small>" if kind < 0.75 else "<br>".join(parts)

    def cookie(self) -> str:
        r = self.r
        text = r.choice(_COOKIE[self.lang])
        out = [r.choice((f"<p>{text}</p>", f"<div>{text}</div>", text + " "))]
        if r.random() < 0.4:
            out.append(f"<p>{self.prose(1, 2, mark=False)}</p>")
        if r.random() < 0.3:
            out.insert(0, f"<h2>{r.choice(_AGREE[self.lang])}?</h2>")
        return "".join(out) + "".join(f"<button>{b}</button>" for b in _AGREE[self.lang])

    def share(self) -> str:
        return '<span>Share</span> <a href="#">link</a> <a href="#">mail</a>'

    def crumbs(self) -> str:
        return " › ".join([self.r.choice(_MENU[self.lang]), self.r.choice(_WORDS["en"]), self.title()])

    def name(self, kind: str) -> str:
        """An attribute that tells what the element is, one that does not, or none."""
        r = self.r
        if self.naming == "none":
            return ""
        if self.naming == "meaningless":
            letters = "".join(r.choice("abcdefghijkmnpqrstuvwxyz") for _ in range(r.randint(1, 5)))
            n = r.choice((f"{letters}{r.randrange(10 ** r.randint(1, 5))}", f"{letters}-{r.randrange(36**3):x}", f"_{r.randrange(16**5):x}", f"{letters}__{letters[::-1]}"))
        else:
            n = r.choice(_NAMES[kind])
            if r.random() < 0.2:
                n = r.choice((f"{n} clearfix", f"site-{n}", f"{n}-1", n.title(), f"{n}__inner"))
        role = {"main": "main", "nav": "navigation", "side": "complementary", "foot": "contentinfo", "cookie": "dialog"}.get(kind)
        if role and r.random() < 0.12:
            return f' role="{role}"'
        return r.choice((f' class="{n}"', f' class="{n}"', f' id="{n}"'))

    def box(self, kind: str, inner: str, tag: str = "div") -> str:
        return f"<{tag}{self.name(kind)}>{inner}</{tag}>"

    def wrapped(self, inner: str, least: int = 0, most: int = 3) -> str:
        for _ in range(self.r.randint(least, most)):
            inner = self.box("wrap", f"\n{inner}\n")
        return inner

    def promo(self) -> str:
        r = self.r
        head = f"<h{(k := r.choice((2, 3, 4)))}>{self.words(1, 4)}</h{k}>" if r.random() < 0.5 else ""
        form = r.choice(("<form><input name=m><button>OK</button></form>", f"<button>{self.words(1, 2)}</button>", f'<a href="/s">{self.words(1, 3)}</a>'))
        return head + f"<p>{self.prose(1, 1, mark=False)}</p>" + form

    def contents(self) -> str:
        return "<ul>" + "".join(f'<li><a href="#{k}">{self.title()}</a></li>' for k in range(self.r.randint(2, 8))) + "</ul>"

    def inside(self, body: str) -> str:
        """The article with things that do not belong to it between its parts."""
        r = self.r
        for part, chance in ((lambda: self.box("promo", self.promo(), r.choice(("div", "aside"))), 0.12), (lambda: self.box("side", self.side(), r.choice(("aside", "aside", "div"))), 0.15), (lambda: self.box("share", self.share()), 0.15), (lambda: self.box("meta", self.contents(), r.choice(("nav", "div"))), 0.05)):
            if r.random() < chance:
                last = body.rfind("<table")
                at = [m.end() for e in ("</p>", "</ul>", "</pre>", "</h1>", "</table>") for m in re.finditer(e, body) if m.start() > last]
                k = r.choice(at) if at else len(body)
                body = f"{body[:k]}\n{part()}\n{body[k:]}"
        return body

    def build(self) -> str:
        r = self.r
        self.naming = r.choices(("telling", "meaningless", "none"), (55, 30, 15))[0]
        empty = r.random() < 0.18
        body = "" if empty else self.article()
        family = r.choice(("semantic", "named", "named", "named", "deep", "flat", "table", "table", "old", "posts", "manual"))
        if body and family == "posts" and r.random() < 0.8:
            posts = ["".join(f"<p>{self.prose(1, 3)}</p>" for _ in range(r.choice((1, 1, 2, 3)))) for _ in range(r.randint(2, 6))]
            first = body if r.random() < 0.4 else f"<h{(k := r.choice((1, 1, 1, 2)))}>{ON}{self.title()}{OFF}</h{k}>"
            name = self.name(r.choice(("main", "wrap")))
            posts = [f"<div{name}>{x}</div>" for x in posts]
            body = "\n".join([r.choice((first, self.box("main", first))), r.choice(("\n".join(posts), self.box("wrap", "".join(posts))))])
        elif body:
            body = self.inside(body)
        if r.random() < 0.3:
            body += self.box("share", self.share())
        menu, side, foot = self.links(3, 9), self.side(), self.foot()
        logo = r.choice(("", "", f"<a href='/'>{self.words(1, 1)}</a>", f"<b>{self.words(1, 2)}</b>", f"<h1>{self.words(1, 2)}</h1>" if "<h1>" in body and r.random() < 0.3 else ""))
        crumb = self.box("crumb", self.crumbs()) if r.random() < 0.4 else ""
        if family == "semantic" or family == "posts" and self.naming == "none":
            inner = r.choice((f"<main><article>\n{body}\n</article></main>", f"<main>\n{body}\n</main>", f"<article>\n{body}\n</article>"))
            inner += f"<aside>{side}</aside>" if r.random() < 0.5 else ""
            page = f"<header>{logo}<nav>{menu}</nav></header>{crumb}{self.wrapped(inner, 0, 2)}<footer>{foot}</footer>"
        elif family in ("named", "posts"):
            main = self.box("main", self.wrapped(f"\n{crumb if r.random() < 0.2 else ''}{body}\n", 0, 2))
            rail = self.box("side", side) if r.random() < 0.7 else ""
            mid = self.wrapped(r.choice((rail + main, main + rail)), 0, 3)
            top = self.box("nav", logo + menu)
            page = r.choice((top + crumb + mid, crumb + mid + top, crumb + top + mid)) + self.box("foot", foot)
            page = self.wrapped(page, 0, 1)
        elif family == "deep":
            parts = [f"<div>{logo}{menu}</div>", self.wrapped(f"\n{body}\n", 1, 4), f"<div>{side}</div>" if r.random() < 0.7 else ""]
            page = self.wrapped(f"{parts[0]}<div>{r.choice((parts[1] + parts[2], parts[2] + parts[1]))}</div>", 0, 2) + f"<div>{foot}</div>"
        elif family == "flat":
            tag = r.choice(("section", "div", "center", ""))
            main = f"<{tag}>\n{body}\n</{tag}>" if tag else body
            low = r.choice((foot, f"<small>{foot}</small>", f"<p>{foot}", f"<address>{foot}</address>"))
            page = r.choice((f"{main}<hr><div>{menu}</div><div>{side}</div><div>{low}</div>", f"{menu}<hr>{main}<hr>{low}", f"<div>{menu}</div>{main}<div>{low}</div>", f"{menu}{main}{low}"))
        elif family == "table":
            wide = lambda: r.choice(("", f" width={r.randrange(80, 400)}", f' width="{r.randrange(10, 40)}%"', " valign=top"))
            cells = [f"<td{wide()}>{side}</td>", f"<td{wide()}>\n{body}\n</td>"]
            if r.random() < 0.2:
                cells.append(f"<td>{self.links(2, 5, long=True)}</td>")
            row = cells if r.random() < 0.6 else cells[::-1]
            if r.random() < 0.25:
                row[row.index(cells[1])] = f"<td><table><tr><td>\n{body}\n</td></tr></table></td>"
            page = f'<table{wide()}><tr><td colspan="{len(row)}">{logo}{menu}</td></tr>\n<tr>{"".join(row)}</tr>\n<tr><td colspan="{len(row)}">{foot}</td></tr></table>'
        elif family == "manual":
            page = f"<header>{logo}{menu}</header>{self.wrapped(self.box('side', self.contents(), r.choice(('nav', 'aside', 'div'))) + self.box('main', body, r.choice(('main', 'div', 'article'))), 0, 2)}{self.box('foot', foot)}"
        else:
            low = r.choice(("<FONT SIZE={}>{}</FONT>".format(r.randint(1, 2), foot), f"<SMALL>{foot}</SMALL>", f"<P>{foot}", f"<ADDRESS>{foot}</ADDRESS>", f"<CENTER>{foot}</CENTER>"))
            tag = r.choice(("DIV", "CENTER", "TD", "BLOCKQUOTE"))
            top = r.choice((f"<CENTER>{menu}</CENTER>", f"<DIV{r.choice((' ALIGN=right', ' ALIGN=left', ' ALIGN=center', ''))}>{menu}</DIV>", f"<P>{menu}"))
            page = f"{top}\n<HR>\n<{tag}>\n{body}\n</{tag}>\n" + (f"<HR><DIV>{side}</DIV>" if r.random() < 0.4 else "") + f"<HR>\n{low}"
        if r.random() < 0.35:
            page += f"<noscript>{r.choice((*_ENABLE, self.sentence(), self.words(2, 6) + '.'))}</noscript>"
        if r.random() < 0.55:
            c = self.box("cookie", self.cookie())
            page = r.choice((c + page, page + c))
        if r.random() < 0.3:
            page += "<script>var menu = '<p>menu</p>';</script>"
        if r.random() < 0.06 and not empty:
            k = page.rfind(OFF)
            page = page[: k + 1] if k > 0 else page
        return f'<!DOCTYPE html>\n<html lang="{self.lang}"><head><meta charset="utf-8"><title>{self.title()}</title><style>p {{ margin: 0 }}</style></head>\n<body>\n{page}\n</body></html>'


def pages(n: int = PAGES, seed: int = 7) -> list[str]:
    """Pages whose article text stands between ON and OFF."""
    r = random.Random(seed)
    return [_Page(r).build() for _ in range(n)]
