"""The four analyses by name, on any of the four stored models, each with its model's usual options."""

from pyspark.sql import DataFrame

from .campaigns import campaign_conversion, campaign_conversion_documents, campaign_conversion_graph
from .recommend import recommend, recommend_documents, recommend_graph
from .search import search, search_documents, search_graph
from .targeting import targeting_score, targeting_score_documents, targeting_score_graph

# The keywords searched for unless others are given.
KEYWORDS = ["light", "bicycle", "refrigerators", "tv"]

ANALYSES = ("q1a", "q1b", "q2", "q3")


def analyse(name: str, form: str, t: dict[str, DataFrame], keywords: list[str] = KEYWORDS, **options) -> DataFrame:
    """Q1a campaign conversion, Q1b targeting score, Q2 recommendations or Q3 search on the tables of a model.

    ``options`` go to the analysis: k (q1a, q1b), limit and exclusion (q2), match and n (q3).
    """
    inline = {"inline_category": True}
    queries = {
        ("q1a", "relational"): lambda o: campaign_conversion(t["messages"], t["campaigns"], **o),
        ("q1a", "wide"): lambda o: campaign_conversion(t["messages"], t["campaigns"], **o),
        ("q1a", "document"): lambda o: campaign_conversion_documents(t["messages"], **o),
        ("q1a", "graph"): lambda o: campaign_conversion_graph(t["SENT_TO"], t["Campaign"], **o),
        ("q1b", "relational"): lambda o: targeting_score(t["messages"], t["clients"], t["friendships"], **o),
        ("q1b", "wide"): lambda o: targeting_score(t["messages"], None, t["friendships"], buyer_from="messages", **o),
        ("q1b", "document"): lambda o: targeting_score_documents(t["users"], t["messages"], **o),
        ("q1b", "graph"): lambda o: targeting_score_graph(t["SENT_TO"], t["BELONGS_TO"], t["FRIENDS_WITH"], **o),
        ("q2", "relational"): lambda o: recommend(t["events"], t["products"], t["categories"], **o),
        ("q2", "wide"): lambda o: recommend(t["events"], t["products"], t["categories"], **inline, **o),
        ("q2", "document"): lambda o: recommend_documents(t["events"], t["products"], **o),
        ("q2", "graph"): lambda o: recommend_graph(t["HAD_EVENT"], t["IN_CATEGORY"], t["Product"], t["Category"], **o),
        ("q3", "relational"): lambda o: search(keywords, t["categories"], t["products"], t["events"], **o),
        ("q3", "wide"): lambda o: search(keywords, t["categories"], t["products"], t["events"], **o),
        ("q3", "document"): lambda o: search_documents(keywords, t["products"], t["events"], **o),
        ("q3", "graph"): lambda o: search_graph(keywords, t["Category"], t["Product"], t["IN_CATEGORY"], t["HAD_EVENT"], **o),
    }
    return queries[name, form](options)
