"""Prompt wrapping, combined selection output and token costs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weblens.functions import lists as L
from weblens.functions.text import estimate_tokens

# FIXED VALUES: prompt template lines per format, in order. "{title}",
# "{url}", "{count}", "{output}" are filled from the capture.
PROMPT_TEMPLATES = {
    "clean-html": [
        'Below is a cleaned DOM capture from the page "{title}".',
        "URL: {url}",
        "Elements captured: {count} | Format: Clean HTML",
        "",
        "The HTML has been stripped of tracking attributes, framework internals, and inline scripts.",
        "Use this to understand the semantic structure, identify elements, or replicate the markup.",
        "",
        "```html",
        "{output}",
        "```",
    ],
    "structure": [
        'Below is a structural tree outline of DOM elements from "{title}".',
        "URL: {url}",
        "Elements captured: {count} | Format: Structure",
        "",
        'Each line shows: tag#id.classes "text preview". Indentation represents nesting depth.',
        "Use this to understand the component hierarchy and locate elements by their position in the tree.",
        "",
        "```",
        "{output}",
        "```",
    ],
    "html-css": [
        'Below is a DOM capture with extracted computed CSS from "{title}".',
        "URL: {url}",
        "Elements captured: {count} | Format: HTML + CSS",
        "",
        "The output includes cleaned HTML followed by computed style rules for the selected subtree.",
        "Use this to replicate the visual appearance, debug layout issues, or extract design tokens.",
        "",
        "{output}",
    ],
    "accessibility": [
        'Below is an accessibility audit of DOM elements from "{title}".',
        "URL: {url}",
        "Elements captured: {count} | Format: Accessibility",
        "",
        'Each line shows: [tag role aria-attrs] "accessible name" plus any warnings.',
        "Warnings include: missing-alt (images without alt text), unnamed-button (buttons without accessible names).",
        "Use this to evaluate WCAG compliance, fix a11y issues, or verify semantic roles.",
        "",
        "```",
        "{output}",
        "```",
    ],
    "selectors": [
        'Below is a selector fingerprint map for DOM elements from "{title}".',
        "URL: {url}",
        "Elements captured: {count} | Format: Selectors",
        "",
        "The JSON contains ranked CSS selectors, XPath expressions, and a fingerprint object.",
        "The fingerprint includes multiple locator strategies grouped by resilience:",
        "  - stable: attribute/content-based selectors that survive DOM restructures",
        "  - positional: CSS paths with nth-of-type that rely on sibling order",
        "  - fragile: absolute paths that break on any structural change",
        "Each selector has been verified for uniqueness against the live DOM.",
        "Use this to build resilient Playwright/Puppeteer/Selenium automation scripts.",
        "",
        "```json",
        "{output}",
        "```",
    ],
    "page-snapshot": [
        'Below is a page-level snapshot of "{title}".',
        "URL: {url}",
        "Format: Page Snapshot",
        "",
        "This includes interactive element counts, landmark regions, heading hierarchy,",
        "and the currently selected element. Use this to understand the page structure",
        "at a glance before drilling into specific elements.",
        "",
        "```",
        "{output}",
        "```",
    ],
}
# FIXED VALUES: the template of any other format.
FALLBACK_TEMPLATE = [
    'DOM capture from "{title}"',
    "URL: {url}",
    "Elements: {count} | Format: {format}",
    "",
    "{output}",
]


def _fill(line: str, fields: dict) -> F.Column:
    parts = []
    rest = line
    while rest:
        i = rest.find("{")
        j = rest.find("}", i) if i >= 0 else -1
        if i < 0 or j < 0 or rest[i + 1:j] not in fields:
            parts.append(F.lit(rest))
            break
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(fields[rest[i + 1:j]])
        rest = rest[j + 1:]
    return F.concat(*parts) if parts else F.lit("")


def build_prompt(fmt, title, url, count, output, templates: dict | None = None, fallback: list[str] | None = None) -> F.Column:
    """``CASE format WHEN ... THEN template`` with a fallback. A job may bring its own
    ``templates``: by format, lines with ``{title}``, ``{url}``, ``{count}``, ``{output}`` and
    ``{format}``, or a function from these columns (by name) to a column."""
    fields = {"title": title, "url": url, "count": count.cast("string"), "output": output, "format": fmt}

    def body(template) -> F.Column:
        return template(fields) if callable(template) else F.concat_ws("\n", *[_fill(x, fields) for x in template])

    expr = None
    for name, template in (PROMPT_TEMPLATES if templates is None else templates).items():
        expr = F.when(fmt == name, body(template)) if expr is None else expr.when(fmt == name, body(template))
    last = body(fallback or FALLBACK_TEMPLATE)
    return last if expr is None else expr.otherwise(last)


def token_costs(outputs: DataFrame, budget: int = L.DEFAULTS["maxTokenWarning"]) -> DataFrame:
    """``(..., chars, tokens, over_budget)`` for every output row."""
    return outputs.select("*", F.length("output").cast("long").alias("chars"),
                          estimate_tokens("output").alias("tokens")).withColumn(
        "over_budget", F.col("tokens") > budget)


def combined_output(outputs: DataFrame) -> DataFrame:
    """Non-empty outputs of a tab's live selections, in selection order,
    joined by a blank line: ``(tab, format, output, items)``."""
    o = outputs.filter(F.col("output") != "")
    return o.groupBy("tab", "format").agg(
        F.expr("listagg(output, '\\n\\n') WITHIN GROUP (ORDER BY sel_order)").alias("output"),
        F.count("*").alias("items"))
