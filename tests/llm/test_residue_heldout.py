"""Notice pages in wordings that no detector knows, on made hosts: recall and precision of the comparison and host evidence."""

import random

from quarryline.llm import residue

_NOTICES = (
    ("Well, this is awkward.", "The shelf you reached for stands empty tonight.", "Perhaps somebody tidied up."),
    ("Leider haben wir hier nur Staub.", "Das Regal ist leer, bitte wählen Sie links ein anderes Fach."),
    ("Oups, rien sur cette étagère !", "Notre équipe range encore les cartons."),
    ("Aquí solo queda polvo.", "El estante se vació durante la mudanza."),
    ("Our lights are out for a short while.", "Engineers carry candles around the cellar.", "Grab a coffee meanwhile."),
    ("This corner wants a livelier browser.", "Switch the sparkle engine back on, then visit again."),
    ("Members only beyond this door.", "Show your badge at the desk and walk right in."),
    ("Easy there, speedy visitor!", "The turnstile opens again after a breather."),
)
_NOUNS = "ledger turbine orchard compass lantern quarry bellows ferry granary harbour kiln loom mortar anvil pulley sluice trellis vineyard windmill beacon cistern drawbridge gangway hopper lattice millrace paddock reservoir spindle turnpike".split()
_VERBS = "lifts carries measures repairs stores paints counts borrows weighs shelters polishes delivers inspects replaces anchors".split()
_ENDS = "before dawn|after the harvest|near the north wall|for the winter crew|without any delay|during the spring flood|beside the old road|under strict watch".split("|")


def _made(seed: int = 3):
    """(doc, text, path, host, is a notice) rows; every host answers unknown addresses in one or two wordings."""
    r, rows, n = random.Random(seed), [], 0
    for host in range(12):
        menu = " | ".join(r.sample(["Rooms", "Prices", "Journal", "Crew", "Visit", "Shop", "Archive", "Letters", "Map", "Tickets"], r.randint(4, 10)) * r.randint(1, 9))
        for wording in r.sample(_NOTICES, 2):
            for _ in range(r.randint(4, 9)):
                said = list(wording) if r.random() < 0.7 else [*wording[:-1], f"Case {r.randrange(16**8):08x}.", wording[-1]]
                slug = "-".join(r.sample(_NOUNS, 3))
                rows.append((n := n + 1, "\n\n".join([menu, "\n".join(said), f"© Host {host}"][r.random() < 0.3 :]), f"pages/{slug}.html", f"h{host}", True))
        byline = f"Written by the crew of house {host}."
        for _ in range(60):
            topic = r.sample(_NOUNS, 3)
            lines = [f"The {r.choice(topic)} {r.choice(_VERBS)} the {r.choice(_NOUNS)} {r.choice(_ENDS)}, and {r.randint(2, 99)} {r.choice(_NOUNS)} crates follow." for _ in range(r.randint(2, 12))]
            slug = "-".join(topic if r.random() < 0.8 else r.sample(_NOUNS, 3))
            rows.append((n := n + 1, "\n\n".join([menu, f"# The {topic[0]} and the {topic[1]}", *lines, byline]), f"pages/{slug}.html", f"h{host}", False))
    return rows


def test_unseen_wordings(spark):
    rows = _made()
    assert not any(residue._ERROR.search(x) or residue._SCRIPT.search(x) for w in _NOTICES for x in w if "sparkle" not in x)
    df = spark.createDataFrame([x[:4] for x in rows], "d bigint, t string, p string, h string")
    got = {x.doc for x in residue.residue(df, "d", "t", "p", "h").collect()}
    true = {x[0] for x in rows if x[4]}
    recall, precision = len(got & true) / len(true), len(got & true) / max(1, len(got))
    print(f"recall {recall:.3f} precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.9


def test_usual_filler_forms_and_navigation():
    kind = residue.residue_kind
    assert kind("Phasellus ultrices nulla quis nibh. Quisque a lectus. Donec ligula vulputate sem tristique cursus.") == "filler"
    assert kind("Suspendisse potenti. In faucibus massa arcu, vitae cursus mi hendrerit nec. Proin bibendum, augue faucibus.") == "filler"
    assert kind("Dear {name},\n\nThank you for your order.") == "placeholder"
    assert kind("Welcome to [Company Name]. We are glad that [Customer] joined.") == "form"
    assert kind("## About\n\nReplace this text with your own description. Add your text here.") == "form"
    assert kind("See [Customer](customer.md) and [Address][a], GET /users/{name} and {count} of them.") is None
    page = "Not found\n" + " | ".join(["Home", "Docs", "Prices", "Search"] * 40) + "\nThe page does not exist."
    assert residue.evidence(page, "docs/tuning-caches.md")[1:4] == (True, True, 0)


def test_a_text_about_notices_is_none():
    text = "# Not found pages\n\nThe page says that the document was removed."
    seen = residue.evidence(text, "docs/not-found-pages.md")
    assert not seen[1]
