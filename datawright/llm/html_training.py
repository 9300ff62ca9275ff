"""Generated pages with known main text, for training and held-out tests of the extraction forest."""

from __future__ import annotations

import random

SYLLABLES = "ba ko ren til mos eva dor qui san lem ort ix ula per gan the of in".split()


def _sentence(r: random.Random, low: int, high: int) -> str:
    words = ["".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
    words = [w + ("," if r.random() < 0.08 else "") for w in words]
    return " ".join(words).capitalize().rstrip(",") + r.choice(["."] * 8 + ["!", "?"])


def _paragraph(r: random.Random) -> str:
    kind = r.random()
    return _sentence(r, 1, 3) if kind < 0.2 else " ".join(_sentence(r, 3, 18) for _ in range(r.randint(1, 9)))


def labelled_pages(seed: int) -> tuple[str, set[str]]:
    """(html, texts of the blocks that are main text) of one page; layouts, class names and markup slips vary."""
    r = random.Random(seed)
    serial = iter(range(10**6))
    main: set[str] = set()

    def unique(text: str) -> str:
        # A number makes each block of a page its own text.
        return f"{text} {next(serial)}" if r.random() < 0.5 else f"{text[:-1]} {next(serial)}."

    def slip(block: str) -> str:
        return f"<p><b>{block}<br>" if r.random() < 0.3 else f"<p>{block}" + ("</p>" if r.random() < 0.9 else "")

    def content() -> list[str]:
        blocks = []

        def add(text: str, shape: str) -> None:
            main.add(text)
            blocks.append(shape.format(text) if shape else slip(text))

        if r.random() < 0.9:
            add(unique(_sentence(r, 2, 12)), f"<h{1 if r.random() < 0.8 else 2}>{{}}</h1>")
        for _ in range(r.choice([0, 1, 1, 2, 3, 5, 8, 14, 25])):
            k = r.random()
            if k < 0.78:
                text = unique(_paragraph(r))
                if r.random() < 0.12:
                    words = text.split(" ")
                    a = r.randrange(len(words))
                    main.add(text)
                    blocks.append("<p>" + " ".join([*words[:a], f'<a href="/x">{words[a]}</a>', *words[a + 1 :]]) + "</p>")
                else:
                    add(text, "")
            elif k < 0.86:
                add(unique(_sentence(r, 1, 6)), "<h2>{}</h2>")
            elif k < 0.92:
                items = [unique(_sentence(r, 1, 12)) for _ in range(r.randint(2, 6))]
                main.update(items)
                blocks.append("<ul>" + "".join(f"<li>{i}</li>" for i in items) + "</ul>")
            elif k < 0.96:
                add(unique(_paragraph(r)), "<blockquote><p>{}</p></blockquote>")
            else:
                cells = [unique(_sentence(r, 1, 4)) for _ in range(4)]
                main.update(cells)
                blocks.append("<table><tr><td>{}</td><td>{}</td></tr><tr><td>{}</td><td>{}</td></tr></table>".format(*cells))
        if not blocks:
            add(unique(_paragraph(r)), "")
        return blocks

    def links(low: int, high: int) -> str:
        return "".join(f'<li><a href="/{k}">{unique(_sentence(r, 1, 3))}</a></li>' for k in range(r.randint(low, high)))

    def menu() -> str:
        name = r.choice(["nav", "menu", "navbar", "main-menu", "top-navigation", "breadcrumbs"])
        inner = f"<ul>{links(2, 9)}</ul>"
        return r.choice([f"<nav>{inner}</nav>", f'<nav class="{name}">{inner}</nav>', f'<div class="{name}">{inner}</div>', f'<div id="{name}">{inner}</div>'])

    def advert() -> str:
        name = r.choice(["ad", "ads", "advert", "banner", "sponsored", "promo", "ad-slot", "adbox"])
        inner = unique(_paragraph(r))
        return f'<{(t := r.choice(["div", "div", "section", "aside"]))} class="{name}">' + (f"<p>{inner}</p>" if r.random() < 0.5 else inner) + f"</{t}>"

    def side() -> str:
        name = r.choice(["sidebar", "side", "widget", "related", "trending", "more-stories"])
        inner = r.choice([f"<h3>{unique(_sentence(r, 1, 3))}</h3><ul>{links(2, 6)}</ul>", f"<p>{unique(_paragraph(r))}</p>" * 1, f"<h3>{unique(_sentence(r, 1, 3))}</h3><p>{unique(_paragraph(r))}</p>"])
        return r.choice([f"<aside>{inner}</aside>", f'<aside class="{name}">{inner}</aside>', f'<div class="{name}">{inner}</div>'])

    def notice() -> str:
        name = r.choice(["cookie", "cookie-notice", "consent", "notice", "alert", "gdpr", "popup"])
        return f'<div {r.choice(["class", "id"])}="{name}">' + r.choice(["<p>{}</p>", "{}", "<p>{}</p><button>OK</button>"]).format(unique(_paragraph(r))) + "</div>"

    def form() -> str:
        name = r.choice(["newsletter", "search", "login", "subscribe", "contact"])
        inner = f"<label>{unique(_sentence(r, 1, 4))}</label><input name=q><button>Go</button>" + (f"<p>{unique(_sentence(r, 3, 12))}</p>" if r.random() < 0.5 else "")
        return r.choice([f"<form>{inner}</form>", f'<form class="{name}">{inner}</form>', f'<div class="{name}"><form>{inner}</form></div>'])

    def comments() -> str:
        name, one = r.choice([("comments", "comment"), ("commentlist", "comment"), ("discussion", "reply"), ("reader-comments", "c"), ("responses", "response")])
        inner = "".join(f'<{(t := r.choice(["div", "li", "p"]))} class="{one}">{unique(_paragraph(r))}</{t}>' for _ in range(r.randint(1, 5)))
        return f'<{(s := r.choice(["div", "section", "ol"]))} {r.choice(["class", "id"])}="{name}">' + (f"<h3>{unique(_sentence(r, 1, 3))}</h3>" if r.random() < 0.5 else "") + inner + f"</{s}>"

    def header() -> str:
        inner = f"<p>{unique(_sentence(r, 1, 8))}</p>" if r.random() < 0.6 else f"<div>{unique(_sentence(r, 1, 4))}</div><ul>{links(1, 4)}</ul>"
        return r.choice([f"<header>{inner}</header>", f'<div class="{r.choice(["header", "masthead", "logo", "topbar"])}">{inner}</div>'])

    def footer() -> str:
        inner = r.choice(["&copy; {} &middot; {}", "<p>{}</p><p>{}</p>", "{} {}"]).format(unique(_sentence(r, 1, 3)), unique(_paragraph(r)))
        return r.choice([f"<footer>{inner}</footer>", f"<footer>{inner}</footer>", f'<div class="{r.choice(["footer", "copyright", "foot", "legal"])}">{inner}</div>'])

    def share() -> str:
        return f'<div class="{r.choice(["share", "social", "share-bar"])}"><ul>{links(1, 4)}</ul></div>'

    blocks = content()
    for extra, chance in ((advert, 0.25), (share, 0.12), (side, 0.12), (form, 0.08), (notice, 0.06)):
        if r.random() < chance:
            blocks.insert(r.randint(1, len(blocks)), extra())
    if r.random() < 0.2:
        blocks.append(comments())
    name = r.choice(["content", "post", "entry", "story", "article-body", "main-text", "post-content"])
    shell = r.choice(["<article>{}</article>"] * 4 + ["<main>{}</main>", "<main><article>{}</article></main>", f'<article class="{name}">{{}}</article>', f'<div class="{name}">{{}}</div>', f'<div id="{name}">{{}}</div>', '<div class="c7">{}</div>', f'<section class="{name}">{{}}</section>'])
    article = shell.replace("{}", "".join(blocks))
    before = [f() for f, chance in ((header, 0.4), (menu, 0.9), (notice, 0.25), (advert, 0.5), (form, 0.15), (side, 0.1)) if r.random() < chance]
    after = [f() for f, chance in ((share, 0.15), (comments, 0.3), (side, 0.4), (form, 0.2), (advert, 0.25), (notice, 0.1), (footer, 0.9)) if r.random() < chance]
    if r.random() < 0.3:
        r.shuffle(before)
    body = "".join([*before, article, *after])
    if r.random() < 0.3:
        body = f'<div id="{r.choice(["page", "wrapper", "container", "site"])}">{body}</div>'
    return f'<!DOCTYPE html><html><head><title>{_sentence(r, 1, 5)}</title><style>p{{margin:0}}</style></head><body>{body}' + ("</body></html>" if r.random() < 0.8 else ""), main
