"""Vocabularies of document conversion."""

from __future__ import annotations

# Font families that mean code.
MONO_FONTS = (
    "courier new", "courier", "consolas", "menlo", "monaco", "sf mono", "lucida console", "andale mono", "dejavu sans mono",
    "liberation mono", "roboto mono", "source code pro", "fira code", "fira mono", "cascadia code", "cascadia mono",
    "ibm plex mono", "jetbrains mono", "inconsolata", "ubuntu mono", "pt mono", "space mono", "monospace",
)

# Heading titles that become bold labels.
LABEL_HEADINGS = (
    "estructura de la llamada", "parametros", "parametros (form-urlencoded)", "ejemplo curl", "ejemplo de curl", "ejemplo respuesta",
    "ejemplo de respuesta", "respuesta del servicio", "respuesta exitosa", "definicion de campos de llamada",
    "definicion de campos de respuesta", "definicion de campos", "cuerpo de la solicitud", "encabezados", "headers",
    "campos de entrada", "campos de salida", "notas", "consideraciones", "request", "request structure", "request body",
    "request headers", "request parameters", "parameters", "query parameters", "path parameters", "example request",
    "example response", "sample request", "sample response", "curl example", "response", "responses", "response fields",
    "response body", "field definitions", "returns", "example",
)

# Sections that are dropped with all they hold.
DROP_SECTIONS = (
    "indice", "contenido", "tabla de contenido", "tabla de contenidos", "table of contents", "contents", "toc",
    "historial de versiones", "control de versiones", "control de cambios", "historial de cambios", "registro de cambios",
    "version history", "revision history", "change log", "changelog", "document history", "document control",
)

# Glyphs that open a callout, and the callout they mean.
CALLOUT_EMOJI = {
    "⚠": "🚧", "⚠️": "🚧", "🚧": "🚧", "❕": "🚧", "🔔": "🚧",
    "ℹ": "📘", "ℹ️": "📘", "📘": "📘", "💡": "📘", "📝": "📘", "📌": "📘",
    "❗": "❗️", "❗️": "❗️", "‼": "❗️", "‼️": "❗️", "⛔": "❗️", "🛑": "❗️", "❌": "❗️", "🚫": "❗️",
    "✅": "👍", "☑": "👍", "👍": "👍", "✔": "👍", "✔️": "👍",
}

# Glyphs of Markdown quotes and components.
QUOTE_EMOJI = {
    "📘": "📘", "ℹ️": "📘", "ℹ": "📘", "💡": "📘", "🚧": "🚧", "⚠️": "🚧", "⚠": "🚧",
    "❗️": "❗️", "❗": "❗️", "🛑": "❗️", "👍": "👍", "✅": "👍",
}

# Patterns (without case) of words that open a callout, and the callout they mean.
CALLOUT_WORDS = (
    (r"^(nota|note|aviso|tip|sugerencia|info(?:rmaci[oó]n)?)\s*[:.—-]\s*", "📘"),
    (r"^(importante|important|atenci[oó]n|attention|advertencia|warning|precauci[oó]n|caution|cuidado)\s*[:.—-]\s*", "🚧"),
    (r"^(peligro|danger|error|cr[ií]tico|critical|no\s+haga|never)\s*[:.—-]\s*", "❗️"),
)

# Themes of callouts.
CALLOUT_THEME = {"📘": "info", "🚧": "warn", "❗️": "error", "👍": "okay"}

# Typographic characters and what they were in code.
SMART_IN_CODE = {
    "“": '"', "”": '"', "„": '"', "‟": '"', "‘": "'", "’": "'", "‚": "'", "‛": "'", "′": "'", "″": '"', "«": '"', "»": '"',
    "…": "...", " ": " ", "​": "",
}

# Tags that are markup in MDX pages, components first; others are placeholders.
KNOWN_TAGS = frozenset((
    "callout", "accordion", "accordions", "tabs", "tab", "card", "cards", "column", "columns", "image", "embed", "anchor", "table", "htmlblock",
    "glossary", "recipe", "code", "terminal",
    "a", "abbr", "b", "blockquote", "br", "caption", "cite", "col", "colgroup", "dd", "del", "details", "div", "dl", "dt", "em", "figcaption",
    "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "i", "iframe", "img", "ins", "kbd", "li", "mark", "ol", "p", "pre", "q", "s", "samp",
    "small", "span", "strong", "sub", "summary", "sup", "tbody", "td", "tfoot", "th", "thead", "tr", "u", "ul", "var", "video", "source", "picture",
))

# Tags without content.
VOID_TAGS = frozenset(("br", "hr", "img", "input", "col", "source", "wbr", "embed", "area"))

# HTML elements that never hold content.
DROP_TAGS = frozenset((
    "script", "style", "noscript", "template", "svg", "canvas", "iframe", "object", "embed", "link", "meta", "form", "input", "button", "select",
    "textarea", "audio", "video", "map", "area",
    "o:p", "o:smarttagtype", "v:shape", "v:shapetype", "v:imagedata", "v:stroke", "v:formulas", "v:path", "w:sdt", "xml",
))

# Elements and roles that are page furniture.
CHROME_TAGS = frozenset(("nav", "aside", "footer"))
CHROME_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search"))

# The pattern (without case) of id and class names of page furniture.
CHROME_HINT = r"(^|[\s_-])(nav|navbar|sidebar|side-?bar|menu|breadcrumb|toc|table-of-contents|on-this-page|pagination|pager|footer|header|masthead|banner|cookie|consent|skip-link|search|social|share|related|feedback|rate-this|edit-this-page|advert|ad-)([\s_-]|$)"

# Where content is looked for, first come first served.
CONTENT_ROOTS = ("main", "article", "[role=main]", "#content", ".markdown-body", "#main-content", ".article-body", ".wiki-content")

# Children that make an element a container of blocks.
BLOCK_CHILDREN = frozenset(("p", "div", "section", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "pre", "blockquote", "figure", "article", "main", "dl"))

#: Frontmatter keys that conversion sets itself.
OWNED_KEYS = frozenset(("title", "hidden", "slug"))
