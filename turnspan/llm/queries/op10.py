"""op10_html_text: the main text of every page."""

from turnspan.llm.html_text import extract
from turnspan.llm.registry import register, table


@register("op10_html_text")
def op10_html_text(spark, sf_dir):
    """A null page has an empty text; see turnspan.llm.html_text for the other edge cases."""
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
