"""Closed vocabularies of the ontology.

Everything in this module is a fixed value that results depend on.
"""

NODE_TYPES = ("Company", "BusinessSegment", "Offering", "CustomerType", "Channel", "Place", "RevenueModel")
SCOPED_TYPES = ("BusinessSegment", "Offering")
RELATIONS = ("HAS_SEGMENT", "OFFERS", "SERVES", "OPERATES_IN", "SELLS_THROUGH", "PARTNERS_WITH", "MONETIZES_VIA")
HIERARCHY_RELATIONS = ("HAS_SEGMENT", "OFFERS")
#: relation -> (subject types, object type)
RELATION_SCHEMA = {
    "HAS_SEGMENT": (("Company",), "BusinessSegment"),
    "OFFERS": (("Company", "BusinessSegment", "Offering"), "Offering"),
    "SERVES": (("BusinessSegment",), "CustomerType"),
    "OPERATES_IN": (("Company",), "Place"),
    "SELLS_THROUGH": (("BusinessSegment", "Offering"), "Channel"),
    "PARTNERS_WITH": (("Company",), "Company"),
    "MONETIZES_VIA": (("Offering",), "RevenueModel"),
}
CANONICAL_LABELS = {
    "CustomerType": (
        "consumers",
        "small businesses",
        "mid-market companies",
        "large enterprises",
        "developers",
        "IT professionals",
        "government agencies",
        "educational institutions",
        "healthcare organizations",
        "financial services firms",
        "manufacturers",
        "retailers",
    ),
    "Channel": ("direct sales", "online", "retail", "distributors", "resellers", "OEMs", "system integrators", "managed service providers", "marketplaces"),
    "RevenueModel": ("subscription", "advertising", "licensing", "consumption-based", "hardware sales", "service fees", "royalties", "transaction fees"),
}
#: label type -> another name that plans may use -> the label
LABEL_ALIASES = {
    "CustomerType": {
        "government": "government agencies",
        "public sector": "government agencies",
        "agencies": "government agencies",
        "agency": "government agencies",
        "healthcare": "healthcare organizations",
        "healthcare firms": "healthcare organizations",
        "providers": "healthcare organizations",
        "health systems": "healthcare organizations",
        "hospitals": "healthcare organizations",
        "enterprise": "large enterprises",
        "enterprise customers": "large enterprises",
        "enterprises": "large enterprises",
        "end users": "consumers",
        "individuals": "consumers",
        "smb": "small businesses",
        "small business": "small businesses",
        "mid market": "mid-market companies",
        "midsize companies": "mid-market companies",
        "midsized companies": "mid-market companies",
    },
    "Channel": {
        "direct": "direct sales",
        "direct selling": "direct sales",
        "website": "online",
        "web": "online",
        "self service": "online",
        "marketplace": "marketplaces",
        "marketplaces": "marketplaces",
        "oem": "OEMs",
        "oems": "OEMs",
        "systems integrators": "system integrators",
        "integrators": "system integrators",
        "msp": "managed service providers",
        "msps": "managed service providers",
    },
    "RevenueModel": {
        "recurring": "subscription",
        "subscriptions": "subscription",
        "ads": "advertising",
        "advertisements": "advertising",
        "usage based": "consumption-based",
        "usage-based": "consumption-based",
        "pay as you go": "consumption-based",
        "pay-as-you-go": "consumption-based",
        "hardware": "hardware sales",
        "services": "service fees",
        "professional services": "service fees",
        "transactions": "transaction fees",
        "transaction": "transaction fees",
    },
}
CORPORATE_SUFFIXES = ("inc", "incorporated", "corporation", "corp", "company", "co", "group", "holdings", "holding", "plc", "ltd", "limited")
REFUSALS = ("unsupported_schema", "unsupported_metric", "unsupported_time", "ambiguous_closed_label", "ambiguous_request", "write_request", "beyond_local_coverage")
ROUTES = ("api_fallback", "local", "refuse")
