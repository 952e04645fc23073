"""Fixed values that results depend on: word lists, suffixes, parameter names."""

# Query parameters that only track a visit.
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "utm_id", "utm_name", "utm_reader", "utm_referrer", "gclid", "fbclid",
    "msclkid", "yclid", "dclid", "igshid", "mc_cid", "mc_eid", "spm",
    "scm", "share_source", "share_medium", "from_source", "from", "ref",
    "referer", "referrer", "source", "src", "s_kwcid", "trk", "si",
]

# Public suffixes of two labels.
MULTI_SUFFIXES = [
    "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn",
    "co.uk", "org.uk", "me.uk", "ltd.uk", "ac.uk", "gov.uk",
    "co.jp", "ne.jp", "or.jp", "ac.jp", "go.jp",
    "com.au", "net.au", "org.au", "edu.au", "gov.au",
    "co.nz", "net.nz", "org.nz", "govt.nz",
    "com.tw", "org.tw", "net.tw", "edu.tw", "gov.tw",
    "com.hk", "org.hk", "net.hk", "edu.hk", "gov.hk",
    "com.sg", "org.sg", "net.sg", "edu.sg", "gov.sg",
    "co.kr", "or.kr", "ne.kr", "go.kr", "re.kr",
    "com.br", "com.mx", "com.ar", "com.tr", "com.ru",
    "co.in", "net.in", "org.in", "gov.in", "ac.in",
    "co.za", "co.il", "com.my", "com.ph", "com.vn", "com.pk",
]

# Title words that carry no meaning.
STOPWORDS = [
    "the", "a", "an", "and", "or", "of", "to", "in", "on", "for", "with",
    "is", "are", "was", "be", "by", "at", "from", "as", "it", "this",
    "that", "your", "you", "we", "our", "us", "how", "what", "why", "best",
    "guide", "tutorial", "official", "home", "homepage", "index", "www",
    "com", "http", "https", "html", "page", "site", "网站", "首页", "官网",
    "教程", "指南", "下载", "免费", "在线",
]

# The shorter suffix list of the legacy base-domain rule.
LEGACY_SUFFIXES = [
    "com.cn", "net.cn", "org.cn", "gov.cn", "edu.cn", "ac.cn",
    "co.uk", "org.uk", "me.uk", "ltd.uk",
    "co.jp", "ne.jp", "or.jp", "ac.jp",
    "com.au", "net.au", "org.au",
    "co.nz", "net.nz", "org.nz",
    "com.tw", "org.tw", "net.tw",
    "com.hk", "org.hk", "net.hk",
    "com.sg", "org.sg", "net.sg",
    "co.kr", "or.kr", "ne.kr",
]
