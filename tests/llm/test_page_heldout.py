"""Pages of a second maker, with layouts and texts that the training pages do not have: recall and precision of blocks."""

import random

from quarryline.llm import page_content

_TEXT = (
    "Rain fell on the harbour while the crew mended nets and told stories about the long winter.|A second survey found that most readers prefer short chapters with clear drawings.|The mill was rebuilt twice, "
    "once after the flood and once after the fire.|Visitors should bring sturdy shoes, since the path climbs steeply behind the chapel.|Nobody expected the vote to be so close, least of all the mayor.|"
    "Each valve must be opened slowly, otherwise the pressure drops and the pump stops.|Die Brücke wurde im Herbst gesperrt, weil ein Pfeiler nachgab.|Le marché ouvre à sept heures et ferme vers midi, sauf le lundi.|"
    "El puerto espera tres barcos nuevos antes de que termine el año.|Store the samples in a cool room and label every jar with the date.|The committee met on Tuesday and agreed to postpone the decision."
).split("|")
_HEADS = "A winter by the harbour|How the mill came back|Opening the valves|Ein Herbst ohne Brücke|Le marché du matin|Three new ships|Notes from the committee|Rooms for samples".split("|")
_LINKS = "Sports|Opinion|Weather|Culture|My account|Basket|Delivery|Jobs|Press|Apps|Podcasts|Letters|Crossword|Shop".split("|")


def _made(r: random.Random) -> tuple[str, list[str]]:
    """(page, blocks of its article)."""
    body, blocks = [], []

    def put(tag: str, text: str, attrs: str = "") -> str:
        blocks.append(text)
        return f"<{tag}{attrs}>{text}</{tag}>"

    def prose() -> str:
        return " ".join(r.sample(_TEXT, r.randint(1, 3)))

    kind = r.choice(("paper", "wiki", "shop", "forum", "plain", "guide", "letter"))
    menu = "".join(f"<li><a href='/{i}'>{x}</a></li>" for i, x in enumerate(r.sample(_LINKS, r.randint(4, 10))))
    more = "".join(f"<li><a href='/m{i}'>{x} {i}</a></li>" for i, x in enumerate(r.sample(_HEADS, r.randint(2, 6))))
    foot = f"<p>Copyright {r.randint(2001, 2026)} The {r.choice(_HEADS)} Company</p><ul>" + "".join(f"<li><a href='/f'>{x}</a></li>" for x in r.sample(_LINKS, 4)) + "</ul>"
    title = r.choice(_HEADS)
    if kind == "paper":
        body = [put("h1", title), *(put("p", prose()) for _ in range(r.randint(2, 7)))]
        body.insert(r.randint(2, len(body)), f"<div class='inset'><h4>Read next</h4><ul>{more}</ul></div>")
        return f"<body><header class='masthead'><a href='/'>The Paper</a><ul>{menu}</ul></header><div class='grid'><article class='lead'>{''.join(body)}</article><div class='rightcol'><h3>Most read</h3><ol>{more}</ol></div></div><footer>{foot}</footer></body>", blocks
    if kind == "wiki":
        body = [put("h1", title), put("p", prose())]
        for _ in range(r.randint(1, 4)):
            body += [put("h2", r.choice(_HEADS) + " again"), put("p", prose()), "<ul>" + "".join(put("li", x) for x in r.sample(_TEXT, 2)) + "</ul>"]
        return f"<body><div id='mw-panel'><ul>{menu}</ul></div><div id='body-main'><div id='inner-text'>{''.join(body)}</div></div><div id='foot-info'>{foot}</div></body>", blocks
    if kind == "shop":
        body = [put("h2", title), put("p", prose()), "<table>" + "".join(f"<tr>{put('th', k)}{put('td', str(r.randint(1, 900)) + ' mm')}</tr>" for k in ("Length", "Width", "Height")) + "</table>", put("p", prose())]
        return f"<body><nav><ul>{menu}</ul></nav><section class='detail'>{''.join(body)}</section><section class='also'><h3>Others bought</h3><ul>{more}</ul></section><div role='dialog'><p>We value your privacy and use cookies.</p><button>Fine</button></div><footer>{foot}</footer></body>", blocks
    if kind == "forum":
        posts = "".join(f"<div class='post'>{put('p', prose())}{put('p', prose()) if r.random() < 0.5 else ''}</div>" for _ in range(r.randint(2, 5)))
        head = put("h1", title)
        blocks.insert(0, blocks.pop())
        return f"<body><div class='menu'><ul>{menu}</ul></div><div class='thread'>{head}{posts}</div><div class='footer'>{foot}</div></body>", blocks
    if kind == "plain":
        body = [put("h1", title), *(put("p", prose()) for _ in range(r.randint(1, 5)))]
        return f"<body><ul>{menu}</ul><hr>{''.join(body)}<hr><small>Copyright {r.randint(2001, 2026)} by the authors.</small></body>", blocks
    if kind == "guide":
        body = [put("h2", title), put("p", prose()), f"<pre>{(blocks.append('pump --open 3 --slow'), 'pump --open 3 --slow')[1]}</pre>", "<ol>" + "".join(put("li", x) for x in r.sample(_TEXT, 3)) + "</ol>"]
        return f"<body><div><div><ul>{menu}</ul></div><div><div>{''.join(body)}</div><div><h4>Also here</h4><ul>{more}</ul></div></div></div><div>{foot}</div></body>", blocks
    body = [put("p", prose()) for _ in range(r.randint(3, 6))]
    return f"<body><div class='topmenu'><ul>{menu}</ul></div><div class='letter-text'>{''.join(body)}</div><div class='bottom-links'>{foot}</div></body>", blocks


def test_unseen_layouts():
    r, model = random.Random(11), page_content.train()
    right = found = true = 0
    for _ in range(400):
        page, blocks = _made(r)
        got = model.blocks(f"<html>{page}</html>")
        right += len(set(got) & set(blocks))
        found += len(set(got))
        true += len(set(blocks))
    assert right / true >= 0.95 and right / found >= 0.95, (right / true, right / found)


def test_headline_below_h1_and_posts():
    model = page_content.train()
    page = "<body><div class='menu'><a href='/'>Home</a> <a href='/d'>Docs</a></div><div class='box'><h2>How the mill came back</h2><p>The mill was rebuilt twice, once after the flood and once after the fire.</p><p>Visitors should bring sturdy shoes, since the path climbs steeply.</p></div><div class='foot'><p>© 2020 The Mill. All rights reserved.</p></div></body>"
    assert model.blocks(page) == ["How the mill came back", "The mill was rebuilt twice, once after the flood and once after the fire.", "Visitors should bring sturdy shoes, since the path climbs steeply."]
    posts = "".join(f"<div class='post'><p>{t}</p></div>" for t in ("The mill was rebuilt twice, once after the flood and once after the fire.", "Nobody expected the vote to be so close, least of all the mayor."))
    got = model.blocks(f"<body><ul><li><a href='/'>Home</a></li><li><a href='/b'>Boards</a></li></ul><div class='thread'><h1>Three new ships</h1>{posts}</div><div class='footer'><p>© 2020 Boards</p></div></body>")
    assert got == ["Three new ships", "The mill was rebuilt twice, once after the flood and once after the fire.", "Nobody expected the vote to be so close, least of all the mayor."]
