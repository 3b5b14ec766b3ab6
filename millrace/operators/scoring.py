"""Candidate scoring: per-page normalisation, weighted sums, ranks, and pattern scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Button patterns (case is ignored) and their weights by kind.
ADD_TO_CART = r"(add[- _]?\w*[- _]?to[- _]?(bag|cart|crt|tote|basket|shop|trolley|wheelbarrow))|(buy[- _]?(it)?[- _]?now)|(shippingATCButton)"
CHECKOUT = r"(proceed|continue)[- _]?(to)?[- _]?(check[- _]?out|pay)|check[- _]?out|pay[- _]?securely[- _]?now|make[- _]?order|order[- _]?now|confirm[- _]?purchase|secure[- _]?check[- _]?out"
CART = (
    r"bag|cart|checkout|tote|basket|trolley|wheelbarrow",
    r"(edit|view|shopping|addedto|my|go[- _]?to)[- _]?(\w[- _]?)*(bag|cart|checkout|tote|basket|trolley|wheelbarrow)",
    r"items[- _]?(\w[- _]?)*(in)?[- _]?(\w[- _]?)*(your)?(bag|cart|checkout|tote|basket|trolley|wheelbarrow)",
    r"delete|remove|continue|empty|clear",
)
SEARCH = r"search|srch|query"


def scaled_by_page(df: DataFrame, page: str, columns: list[str]) -> DataFrame:
    """Columns scaled to 0..1 within a page; 0 where a page has one value alone."""
    w = Window.partitionBy(page)
    for c in columns:
        low, high = F.min(c).over(w), F.max(c).over(w)
        df = df.withColumn(f"{c}_scaled", F.coalesce(F.try_divide((F.col(c) - low).cast("double"), (high - low).cast("double")), F.lit(0.0)))
    return df


def ranked(df: DataFrame, page: str, weights: dict[str, float], tie: str, threshold: float) -> DataFrame:
    """score, rank, second score and whether a candidate is its page's choice (first and above `threshold`)."""
    scaled = scaled_by_page(df, page, list(weights))
    score = sum((F.col(f"{c}_scaled") * w for c, w in weights.items()), F.lit(0.0))
    order = Window.partitionBy(page).orderBy(F.desc("score"), tie)
    out = scaled.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(order)).withColumn("next_score", F.lead("score").over(order))
    return out.withColumn("chosen", (F.col("rank") == 1) & (F.col("score") > threshold))


def link_rank(df: DataFrame, page: str, probability: str, area: str) -> Column:
    """probability + root of the area over the page's largest root; the probability alone if that is below 1."""
    most = F.sqrt(F.max(F.col(area).cast("double")).over(Window.partitionBy(page)))
    return F.when(most < 1, F.col(probability)).otherwise(F.col(probability) + F.sqrt(F.col(area).cast("double")) / most)


def pattern_score(pattern: str, text: Column, target: Column, source: Column, attributes: Column, parent: Column) -> Column:
    """5 each for text, target (href or handler) and source, 3 each for own and parent's attributes, of 21."""
    has = lambda c: F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False)).cast("int")
    return (5 * has(text) + 5 * has(target) + 5 * has(source) + 3 * has(attributes) + 3 * has(parent)) / F.lit(21.0)


# The weights of a button's features and the least score of a choice, by kind of button.
BUTTONS = {
    "add_to_cart": ({"color_dist": 0.1, "regex_1": 0.6, "area": 0.3}, 0.5, (ADD_TO_CART,)),
    "cart": ({"less_area": 0.15, "in_header": 0.05, "regex_1": 0.2, "regex_2": 0.3, "regex_3": 0.3, "regex_4": -0.2}, 0.2, CART),
    "checkout": ({"color_dist": 0.2, "regex_1": 0.6, "area": 0.2}, 0.5, (CHECKOUT,)),
}


def button_candidates(df: DataFrame, kind: str, page: str, tie: str) -> DataFrame:
    """score, rank, next score and choice of each candidate button of a page, for a kind of BUTTONS. `df` has a
    row a candidate: text, target, source, attributes and parent (strings), area, color_dist (from the
    background) and in_header (whether an element above is a header's). Features are scaled within a page."""
    weights, least, patterns = BUTTONS[kind]
    parts = [F.col(c) for c in ("text", "target", "source", "attributes", "parent")]
    scored = df.withColumns({f"regex_{k}": pattern_score(p, *parts) for k, p in enumerate(patterns, 1)})
    scored = scored.withColumns({"less_area": -F.col("area"), "in_header": F.col("in_header").cast("int")})
    return ranked(scored, page, weights, tie, least)


def is_product_page(html: Column) -> Column:
    """Counts of the two purchase phrases decide: one of them once or twice, the other never."""
    from ..functions.text import count_of

    low = F.lower(html)
    cart, bag = count_of(low, "add to cart"), count_of(low, "add to bag")
    return (cart.between(1, 2) & (bag == 0)) | (bag.between(1, 2) & (cart == 0))
