"""Vocabularies, thresholds and rate tables of the news-signal model."""

from __future__ import annotations

#: The editorial domains, with half-life in hours, authority weight and similarity floor.
DOMAINS = {
    "economy": (48, 1.0, 0.70),
    "economics": (336, 1.2, 0.72),
    "scitech": (168, 1.0, 0.70),
    "geopolitics": (120, 1.1, 0.68),
    "national": (72, 1.0, 0.70),
}

#: The strategic tags.
TAGS = ["post-america", "energy-transition", "china-decoupling", "ai-safety", "demographic-shift", "supply-chain-realignment", "climate-policy", "labor-markets", "monetary-policy", "inequality", "tech-platforms", "biosecurity"]

#: USD for a million input and output tokens by model; unknown models pay the dearest rate.
PRICES = {
    "text-embedding-3-small": (0.02, 0.0),
    "claude-sonnet-4.5": (3.0, 15.0),
    "claude-haiku-4.5": (1.0, 5.0),
    "gemini-2.5-flash-lite": (0.1, 0.4),
    "gemini-3.1-flash-lite": (0.25, 1.5),
    "gemini-3.5-flash": (1.5, 9.0),
}
DEAREST = "claude-sonnet-4.5"

#: The budget bucket of each stage.
BUCKETS = {"normalise": "normalize", "embed": "normalize", "stage4_summarise": "orchestrator", "stage6_curate": "orchestrator", "weekly_brief": "brief"}

#: Trending weights.
HEAT_WEIGHT = {"cold": 0.25, "warm": 1.0, "over_saturated": 2.0, "hot": 3.0}
TRAJECTORY_WEIGHT = {"new": 1.0, "rising": 1.5, "peaking": 1.25, "declining": 0.5}
HEAT_RANK = {"cold": 0, "warm": 1, "over_saturated": 2, "hot": 3}

#: Query parameters that only track, by name or by the name's beginning.
TRACKING_NAMES = ["fbclid", "gclid", "mc_cid", "mc_eid", "ref", "ref_src", "igshid", "_hsmi", "_hsenc"]
TRACKING_PREFIXES = ["utm_", "at_"]
LINK_TRACKING_NAMES = ["utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "utm_id", "utm_name", "utm_brand", "fbclid", "gclid", "msclkid", "dclid", "yclid", "mc_cid", "mc_eid", "_hsmi", "_hsenc", "mkt_tok"]

#: Hosts of share links.
SOCIAL_HOSTS = ["twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "reddit.com", "pinterest.com", "threads.net", "t.me", "tiktok.com", "mastodon.social", "bsky.app", "youtube.com", "youtu.be"]

#: Patterns on a lower-cased path and query.
TRACKING_LINKS = [r"\b(beacon|pixel|open\.gif|open\.png|tracking\.gif|track/open)\b"]
MASTHEAD_LINKS = [
    r"\bview[-_/.]?(this[-_/.]?)?(email|message)?[-_/.]?(in|on)?[-_/.]?(your[-_/.]?)?(browser|web|online)\b",
    r"\bread[-_/.]?(in|on)?[-_/.]?(browser|web|online)\b",
    r"\bview[-_/.]?in[-_/.]?browser\b",
    r"\bweb[-_/.]?version\b",
]

#: Beginnings of a newsletter's footer or preamble line, lower case.
BOILERPLATE = [
    r"^[ \t]*unsubscribe\b",
    r"^[ \t]*if you no longer wish to receive",
    r"^[ \t]*view (this )?(email|message) in your browser",
    r"^[ \t]*this (email|message) was sent to ",
    r"^[ \t]*to stop receiving",
    r"^[ \t]*manage (your )?(subscription|preferences)",
    r"^[ \t]*update your preferences",
    r"^[ \t]*sent (with )?love by",
    r"^[ \t]*©\s*\d{4}",
    r"^[ \t]*copyright\s*©",
]

#: Domains of mail services, which say nothing of the publisher.
TRANSPORT_DOMAINS = ["mcsv.net", "mcdlv.net", "list-manage.com", "campaign-archive.com", "mailchimp.com", "amazonses.com", "sendgrid.net", "sendgrid.com", "mailgun.net", "mailgun.org", "sendinblue.com", "brevo.com", "postmarkapp.com", "mtasv.net", "sparkpostmail.com", "mandrillapp.com", "convertkit.com", "kit.com", "beehiiv.com", "mail.beehiiv.com"]

#: Aggregator feeds whose items must come from a listed host.
AGGREGATOR_FEEDS = r"(?i)((^|/)hnrss\.org/|news\.ycombinator\.com)"
#: Editorially trusted hosts.
TRUSTED_HOSTS = [
    "nytimes.com", "washingtonpost.com", "wsj.com", "ft.com", "theguardian.com", "bbc.com", "bbc.co.uk", "reuters.com", "apnews.com", "bloomberg.com", "economist.com", "theatlantic.com", "newyorker.com", "newrepublic.com", "politico.com", "axios.com", "thehill.com", "time.com", "vox.com", "fivethirtyeight.com", "theinformation.com", "semafor.com",
    "arstechnica.com", "theverge.com", "wired.com", "technologyreview.com", "spectrum.ieee.org", "ieee.org", "acm.org", "lwn.net", "phoronix.com", "thenewstack.io", "theregister.com", "protocol.com", "restofworld.org",
    "stratechery.com", "astralcodexten.com", "slowboring.com", "noahpinion.blog", "matthewyglesias.substack.com", "mattlevine.bloomberg.com", "oneusefulthing.org", "pluralistic.net", "danluu.com", "jasonkottke.org", "kotaku.com", "lesswrong.com",
    "nature.com", "science.org", "pnas.org", "nejm.org", "cell.com", "thelancet.com", "arxiv.org", "biorxiv.org", "medrxiv.org", "nih.gov", "cdc.gov", "who.int",
    "foreignaffairs.com", "foreignpolicy.com", "cfr.org", "rand.org", "csis.org", "brookings.edu", "aei.org", "piie.com", "sipri.org", "iiss.org",
    "scmp.com", "nikkei.com", "asia.nikkei.com", "caixin.com", "sixthtone.com",
]

#: Anchors and bare URLs of a newsletter, links that manage a subscription, code fences and trailing commas of model answers.
HREF = "(?i)<a\\s[^>]*\\bhref\\s*=\\s*[\"']([^\"']+)[\"']"
BARE = "\\bhttps?://[^\\s<>\"')]+"
LIST_ADDRESS = "(?i)\\b(unsubscribe|email[-_ ]?preferences|opt[-_ ]?out)\\b"
FENCE = "(?i)^\\s*```[a-z0-9]*\\s*\\n?"
FENCE_END = "```\\s*$"
TRAILING_COMMA = ",(\\s*[}\\]])"
