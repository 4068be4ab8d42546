"""Main body of a page by tree scoring.

A tolerant tag scanner builds the block tree of the html. Paragraph-like blocks pass points for
length and commas to their parent, and half of them to the grandparent; the points of a container
are discounted by its link density and by what its name says. The best container and those of its
siblings that score well or read like paragraphs are kept; furniture inside them is cut out again.
The kept blocks are then found in the lines of the markdown. Where a page has no html, the lines of
the markdown are grouped into sections and scored in the same way.
"""

from __future__ import annotations

import html as htmllib
import re
from dataclasses import dataclass, field
from functools import lru_cache

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|template|svg)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)([^<>]*)>|<![^>]*>", re.S | re.I)
_NAME = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
#: A start tag of the key ends an open element of the set.
_CLOSES = {
    "p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "tr": ("td", "th", "tr", "p"),
    "option": ("option",), **dict.fromkeys("h1 h2 h3 h4 h5 h6 ul ol table pre div section article aside main header footer nav form blockquote".split(), ("p",)),
}
#: Elements beyond which a start tag does not look for something to end.
_SCOPE = frozenset("table ul ol div section article aside main body html blockquote td th".split())
_FURNITURE_TAGS = frozenset("nav footer aside form noscript button select header iframe dialog menu".split())
# Words of class, id and role that name furniture or the body.
_FURNITURE_NAME = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adslot|advert\w*|banner\w*|bottom|breadcrumbs?|crumbs?|comments?|consent|cookies?|cc|gdpr|privacy|notice|disqus|footer|foot|langs?|language\w*|login|menu|menubar|modal|nav|navbar|navigation|"
    r"newsletter|overlay|pager|pagination|popup|promo\w*|rail|related|recommend\w*|search|share|sharing|sidebar|side|signup|sign-up|social|sponsor\w*|subscribe|tags?|toolbar|top|topbar|widget)(?:$|[\s_-])",
    re.I,
)
_BODY_NAME = re.compile(r"(?:^|[\s_-])(?:article|body|content|entry|main|page|post|text|blog|story|col)(?:$|[\s_-]|\d)", re.I)
_SPACE = re.compile(r"\s+")


_PARAGRAPHS = frozenset("p pre blockquote li td h1 h2".split())
_MAY_HOLD = frozenset("td li blockquote".split())
_TITLES = frozenset("h2 h3 h4 h5 h6".split())
_BOXES = frozenset("table tr td div section ul ol article main".split())


@dataclass(slots=True)
class Node:
    tag: str
    name: str
    parent: Node | None
    children: list = field(default_factory=list)
    points: float = 0.0
    text: int = 0
    linked: int = 0
    titles: int = 0
    furniture: bool = False


def parse(source: str) -> Node:
    """The tree of an html text; children are Nodes and strings. Any text gives a tree."""
    root = node = Node("#root", "", None)
    at = 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            node.children.append(source[at:m.start()])
        at = m.end()
        tag = m[3]
        if tag is None:
            continue
        tag = tag.lower()
        if m[2]:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if tag == "br":
            node.children.append("\n")
            continue
        for ends in (_CLOSES.get(tag, ()),):
            if not ends:
                break
            up = node
            while up.parent is not None and up.tag not in ends and up.tag not in _SCOPE:
                up = up.parent
            while up.parent is not None and up.tag in ends:
                node = up.parent
                up = node
        attrs = m[4]
        name = " ".join(filter(None, (g for n in _NAME.findall(attrs) for g in n))) if "=" in attrs else ""
        child = Node(tag, name, node)
        node.children.append(child)
        if tag not in _VOID and not attrs.endswith("/"):
            node = child
    if at < len(source):
        node.children.append(source[at:])
    return root


@lru_cache(maxsize=20_000)
def _names_furniture(name: str) -> bool:
    return _FURNITURE_NAME.search(name) is not None


@lru_cache(maxsize=20_000)
def _names_body(name: str) -> bool:
    return _BODY_NAME.search(name) is not None


def measure(node: Node) -> None:
    """Text and link lengths, furniture marks and points, bottom up; the walk keeps its own stack."""
    order, stack = [], [(node, False, False)]
    while stack:
        n, linked, hidden = stack.pop()
        hidden = hidden or n.tag in _FURNITURE_TAGS or (n.name != "" and _names_furniture(n.name))
        n.furniture = hidden
        order.append((n, linked))
        for c in n.children:
            if type(c) is Node:
                stack.append((c, linked or c.tag == "a", hidden))
    for n, linked in reversed(order):
        commas = 0
        for c in n.children:
            if type(c) is Node:
                n.text += c.text
                n.linked += c.linked
                n.titles += c.titles
            else:
                size = len(c) if not c.isspace() else 0
                n.text += size
                if linked:
                    n.linked += size
                commas += c.count(",") + c.count("、")
        if n.tag in _TITLES:
            n.titles = n.text
        leaf = n.tag in _PARAGRAPHS and not (n.tag in _MAY_HOLD and any(type(c) is Node and c.tag not in _INLINE for c in n.children))
        if leaf and n.text and not n.furniture:
            score = (1 + commas + min(n.text / 60, 4)) * (1 - n.linked / max(n.text, 1))
            if n.tag in ("h1", "h2"):
                score = 3.0 if n.tag == "h1" else 1.0
            up = n.parent
            while up is not None and up.tag in ("ul", "ol", "tr", "tbody", "table", "p", "b"):
                up = up.parent
            if up is not None:
                up.points += score
                if up.parent is not None:
                    up.parent.points += score / 2


def _worth(n: Node) -> float:
    base = n.points * (1 - n.linked / max(n.text, 1))
    if n.tag in ("article", "main") or (n.name != "" and _names_body(n.name)):
        base *= 1.25
    return 0.0 if n.furniture else base


def body_nodes(root: Node) -> list[Node | str]:
    """The best container with its good siblings, or nothing."""
    measure(root)
    best, top, stack = None, 0.0, [root]
    while stack:
        n = stack.pop()
        if n.tag != "head":
            worth = _worth(n)
            if worth > top:
                best, top = n, worth
            stack.extend(c for c in n.children if type(c) is Node)
    if best is None:
        return []
    if best.parent is None or best.tag in ("body", "html"):
        return [best]
    keep: list[Node | str] = []
    for c in best.parent.children:
        if c is best:
            keep.append(c)
        elif type(c) is Node and not c.furniture and c.tag != "head":
            reads_well = c.tag == "p" and c.text > 80 and c.linked < c.text * 0.25
            if _worth(c) >= max(8.0, top * 0.2) or reads_well or c.tag in ("h1",):
                keep.append(c)
    return keep


def _links_only(n: Node) -> bool:
    """True for a box that holds links and their titles only."""
    return n.tag in _BOXES and n.linked > 0 and n.text - n.titles <= n.linked * 1.1


def block_texts(nodes: list[Node | str], furniture: bool = False, links: bool = True) -> list[str]:
    """Texts of the blocks in order; furniture inside is left out unless asked for, boxes of links if told so."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if run:
            joined = htmllib.unescape("".join(run))
            for line in joined.split("\n"):
                line = " ".join(line.split())
                if line:
                    out.append(line)
            run.clear()

    stack: list = list(reversed(nodes))
    while stack:
        n = stack.pop()
        if n is None:
            flush()
        elif type(n) is str:
            run.append(n if n == "\n" or "\n" not in n else n.replace("\n", " "))
        elif n.tag == "#pre":
            run.append(n.name)
        elif (n.furniture and not furniture) or n.tag in ("head", "title") or (not links and _links_only(n)):
            flush()
        else:
            inline = n.tag in _INLINE
            if not inline:
                flush()
                stack.append(None)
            if n.tag == "pre":
                for c in reversed(n.children):
                    stack.extend([Node("#pre", c, None)] if type(c) is str else [Node("#pre", x, None) for x in reversed(_strings(c))])
            elif n.tag == "tr":
                cells = [" ".join(block_texts([c], furniture)) for c in n.children if type(c) is Node]
                if len(cells) > 1:
                    run.append(" ".join(cells))
                else:
                    stack.extend(reversed(n.children))
            else:
                stack.extend(reversed(n.children))
    flush()
    return out


def message_texts(root: Node) -> list[str]:
    """Texts outside furniture and boxes of links, and those for browsers without scripts: what a page says when it has no body."""
    out: list[str] = []
    stack: list[Node] = [root]
    quiet: list[Node] = []
    while stack:
        n = stack.pop()
        if n.tag == "noscript":
            quiet.append(n)
        else:
            stack.extend(c for c in reversed(n.children) if type(c) is Node)
    for n in quiet:
        out.extend(block_texts(list(n.children), True))
    return [x for x in block_texts([root], links=False) if not _path_line(x)] + out


def _strings(n: Node) -> list[str]:
    found: list[str] = []
    for c in n.children:
        found.extend([c] if type(c) is str else _strings(c))
    return found


_LINK = re.compile(r"!?\[([^\]]*)\]\([^)]*\)")
_LEAD = re.compile(r"^\s*(?:#{1,6}\s+|[-*+•]\s+|\d+[.)]\s+|>\s?)*")
_RULE = re.compile(r"^[\s|:\-=_*`~]+(?:\w+)?$")
_HAS_MARK = re.compile(r"[*_`|\\#>~-]")
_INLINE_MARKS = re.compile(r"[*_`|\\#>~]+|(?<!\w)-(?!\w)")


def plain(line: str) -> str:
    """A line of markdown or html text without marks, for comparison."""
    if "](" in line:
        line = _LINK.sub(r"\1", line)
    line = line.strip()
    if not line[:1].isalpha():
        line = _LEAD.sub("", line)
    if "&" in line:
        line = htmllib.unescape(line)
    if _HAS_MARK.search(line):
        line = _INLINE_MARKS.sub(" ", line)
    return " ".join(line.split()).casefold()


# Wording of page furniture in the four languages of the pages (lines without marks, in lower case).
_LINE_FURNITURE = re.compile(
    r"^(?:skip to (?:main )?content|zum inhalt springen|saltar al contenido|aller au contenu"
    r"|(?:\d+ )?(?:comments?|kommentare?|antworten|comentarios?|respuestas?|commentaires?|réponses?)(?: \(\d+\))?|\d+ people found this useful|leave a reply.*"
    r"|\d+ (?:personen|personas|personnes) .{0,60}"
    r"|(?:tell a friend|share this page|seite teilen|compartir(?: .{0,30})?|partager(?: .{0,30})?|weitersagen|copy link\b.*|drucken ·.*|imprimir ·.*|imprimer ·.*|.* · (?:print|weiterleiten|enviar|envoyer)(?: · .*)?)"
    r"|(?:search(?: this site)?|suche|buscar|rechercher)|(?:(?:en|de|es|fr) ?[|/·]? ?){2,}"
    r"|(?:sponsored|advertisement|promoted content|ad – .*|anzeige|gesponsert|werbung|publicité|contenu sponsorisé|publicidad|patrocinado|contenido patrocinado)"
    r"|(?:subscribe|abonnieren|jetzt abonnieren|suscríbase|suscríbete|abonnez-vous|newsletter ?:|boletín ?:|lettre d'information ?:|join \d+ readers|never miss a story).*"
    r"|©.*|\(c\) \d{4}.*|copyright \d{4}.*|\d{4} · .*"
    r"|.*\b(?:cookies?|kleine dateien auf ihrem gerät|small files on your device|(?:pequeños archivos|archivos pequeños) en su dispositivo|petits fichiers sur votre appareil)\b.{0,80}\b(?:count visits|faster next time|our policy|zählen|schneller laden|richtlinie beschrieben|contar visitas|nuestra política|más rápido|compter les visites|notre politique|plus vite).{0,40}"
    r"|.* utiliza cookies .*|diese website nutzt cookies .*|ce site utilise des cookies .*"
    r")$"
)
# Labels of menus, consent buttons and legal links.
_LABELS = frozenset(x.strip() for x in """
home, archive, guides, careers, products, newsroom, community, help centre, about us, pricing, contact, sign in, terms of use, accessibility, imprint, privacy, sitemap, do not sell my data,
accept all, reject optional, manage settings, only what is needed, got it,
startseite, archiv, ratgeber, karriere, produkte, presse, forum, hilfe, über uns, preise, kontakt, anmelden, nutzungsbedingungen, barrierefreiheit, impressum, datenschutz, alle akzeptieren, nur notwendige, einstellungen, ablehnen,
inicio, archivo, guías, empleo, productos, prensa, comunidad, foro, ayuda, quiénes somos, precios, contacto, iniciar sesión, condiciones de uso, accesibilidad, aviso legal, privacidad, aceptar todo, rechazar, configurar, aceptar, solo lo necesario,
accueil, archives, recrutement, produits, communauté, aide, à propos, tarifs, connexion, conditions d'utilisation, accessibilité, mentions légales, confidentialité, tout accepter, refuser, paramétrer, plan du site, nur das nötige, verstanden
""".replace("\n", " ").split(","))
_LABELS_BY_LENGTH = sorted(_LABELS, key=len, reverse=True)
_LABEL_STARTS = frozenset(x.split(" ", 1)[0] for x in _LABELS)
_RELATED = re.compile(
    r"^(?:related articles?|you may also like|more from this section|most read(?: today)?|das könnte sie auch interessieren|ähnliche artikel|meistgelesen.*|mehr aus .*|artículos relacionados|también le puede (?:gustar|interesar)|más de .*|lo más leído.*"
    r"|sur le même sujet|à lire aussi|articles (?:liés|similaires)|les plus lus.*|plus dans cette rubrique)$"
)
_OFFER = re.compile(r"[-−–]\s?\d+\s?%$")
_SPLIT_LABELS = re.compile(r"\s*[|·/›•]\s*|\]\([^)]*\)\s*\[?|\s{2,}")


def furniture_line(line: str) -> bool:
    """True for a line of markdown whose wording or labels are those of page furniture."""
    text = plain(line)
    if not text:
        return False
    return text in _LABELS or _furniture_text(text) or _furniture_labels(line.strip(), text)


@lru_cache(maxsize=50_000)
def _furniture_text(text: str) -> bool:
    return _LINE_FURNITURE.match(text) is not None


def _furniture_labels(line: str, text: str) -> bool:
    """True for rows of labels, however they are set apart."""
    if text.split(" ", 1)[0] not in _LABEL_STARTS:
        return False
    labels = [x.strip(" [-").casefold() for x in _SPLIT_LABELS.split(line) if x.strip(" [-")]
    if len(labels) > 1 and sum(x in _LABELS for x in labels) * 2 > len(labels):
        return True
    words = text
    for label in _LABELS_BY_LENGTH:
        if label in words:
            words = words.replace(label, " ")
    return not words.strip()


def markdown_tree(lines: list[str]) -> tuple[Node, dict[int, Node]]:
    """A tree of sections and blocks from markdown lines; and the block of every line that is not blank."""
    root = Node("#root", "", None)
    section, level, owner = Node("section", "start", root), 0, {}
    root.children.append(section)
    block: Node | None = None
    fenced = after_ad = False
    for i, line in enumerate(lines):
        text = line.strip()
        if text.startswith("```"):
            if not fenced:
                block = Node("pre", "", section)
                section.children.append(block)
            fenced = not fenced
            owner[i] = block
            continue
        if fenced:
            block.children.append(line + "\n")
            owner[i] = block
            continue
        if not text:
            block = None
            continue
        head = re.match(r"(#{1,6})\s+\S", text)
        if head:
            related = bool(_RELATED.match(plain(text)))
            after_ad = False
            if len(head[1]) == 1 and level != 1:
                section, level = Node("section", "body", root), 1
                root.children.append(section)
            tag = "h1" if len(head[1]) == 1 else "h2"
            node = Node("aside" if related else tag, "", section)
            node.children.append(plain(text))
            section.children.append(node)
            block, owner[i] = (node if related else None), node
            continue
        if _RELATED.match(plain(text)):
            block = Node("aside", "", section)
            section.children.append(block)
        listed = re.match(r"(?:[-*+•]|\d+[.)])\s", text)
        if block is not None and block.tag == "aside" and (listed or not block.children or text.startswith("[")):
            block.children.append(text)
            owner[i] = block
            continue
        tag = "ul" if listed else "table" if text.startswith("|") else "p"
        if block is None or block.tag != tag or tag == "p":
            block = Node(tag, "", section)
            section.children.append(block)
        if furniture_line(text) or (after_ad and _OFFER.search(text)):
            # A line of furniture is a block of its own, so that it doesn't take its neighbours along.
            block = Node("p", "ad", section)
            section.children.append(block)
            after_ad = True
        else:
            after_ad = False
        block.children.append(_as_node(text, block))
        owner[i] = block
    return root, owner


def _as_node(text: str, parent: Node) -> Node:
    item = Node("li" if parent.tag == "ul" else "td" if parent.tag == "table" else "span", "", parent)
    at = 0
    for m in _LINK.finditer(text):
        item.children.append(text[at:m.start()])
        link = Node("a", "", item)
        link.children.append(m[1])
        item.children.append(link)
        at = m.end()
    item.children.append(text[at:])
    return item


_CRUMBS = re.compile(r"^([^›/.!?]{1,40}) ([›/]) [^›/]{1,60} \2 .+")


def _path_line(line: str) -> bool:
    """True for the path of a page below a label of the site's menu."""
    crumbs = _CRUMBS.match(line.strip())
    return crumbs is not None and crumbs[1].strip(" [").casefold() in _LABELS


def markdown_messages(lines: list[str]) -> list[str]:
    """Lines outside furniture where only the markdown is there: no lists under a heading of the site, no paths."""
    root, owner = markdown_tree(lines)
    measure(root)
    out = []
    for i in sorted(owner):
        if not owner[i].furniture and not _path_line(lines[i]):
            out.append(lines[i])
    return out


def markdown_body(lines: list[str]) -> list[int]:
    """Positions of the body's lines where only the markdown is there."""
    root, owner = markdown_tree(lines)
    measure(root)
    best = max((s for s in root.children if type(s) is Node), key=_worth, default=None)
    if best is None or not best.points:
        return []
    body = [i for i, b in owner.items() if b.parent is best and not b.furniture and not furniture_line(lines[i])]
    return sorted(body)


def markdown_lines(html: str | None, markdown: str | None) -> list[int]:
    """Numbers, from 1, of the lines of markdown that belong to the main body."""
    if not markdown or not markdown.strip():
        return []
    lines = markdown.split("\n")
    if html and html.strip():
        return [i + 1 for i in match_lines(block_texts(body_nodes(parse(html))), lines)]
    return [i + 1 for i in markdown_body(lines)]


def match_lines(texts: list[str], lines: list[str]) -> list[int]:
    """Positions of the lines whose text is a kept block; fences and table rules stay with their neighbours."""
    kept = {plain(t) for t in texts}
    kept.discard("")
    found: list[int] = []
    held: list[int] = []
    for i, line in enumerate(lines):
        text = line.strip()
        if not text:
            continue
        if _RULE.match(text) and not plain(text):
            held.append(i)
            continue
        if text.startswith("```"):
            held.append(i)
            continue
        if plain(line) in kept:
            found.extend(held)
            found.append(i)
        elif held and found and held[0] > found[-1]:
            found.extend(h for h in held if all(not lines[j].strip() for j in range(found[-1] + 1, h)))
        held = []
    if held and found:
        found.extend(h for h in held if all(not lines[j].strip() for j in range(found[-1] + 1, h)))
    return sorted(set(found))
