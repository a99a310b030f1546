"""Fixed values of the risk board: codes, their labels and their order."""

# The twelve phases, in run order.
PHASES = [
    "WEB_ICP", "WEB_CRAWL", "IMAGE_DOWNLOAD", "OCR", "KEYWORD", "ACCOUNT_DISCOVERY",
    "ACCOUNT_RANK", "ACCOUNT_REVIEW", "ACCOUNT_VERIFY", "POST_CRAWL", "RISK_ANALYSIS",
    "RISK_EVIDENCE",
]

# Display labels by group and code.
LABELS = {
    "phase": {
        "WEB_ICP": "备案载体查询", "WEB_CRAWL": "官网抓取", "IMAGE_DOWNLOAD": "图片下载",
        "OCR": "图片文字识别", "KEYWORD": "关键词筛查", "ACCOUNT_DISCOVERY": "社媒账号发现",
        "ACCOUNT_RANK": "账号筛选排序", "ACCOUNT_REVIEW": "账号人工复核",
        "ACCOUNT_VERIFY": "账号身份核验", "POST_CRAWL": "社媒内容抓取",
        "RISK_ANALYSIS": "风险分析研判", "RISK_EVIDENCE": "风险证据整理",
    },
    "companyStatus": {"CLOSED": "已完成", "OPEN": "进行中"},
    "taskStatus": {
        "OK": "成功", "FAILED": "失败", "RETRY_WAIT": "等待重试", "RUNNING": "运行中",
        "PENDING": "排队中", "TERMINAL": "已结束",
    },
    "error": {
        "social_login_wait_timeout": "社媒登录等待超时", "process_error": "处理过程异常",
        "deterministic_dns_error": "域名无法解析",
        "target_identity_mismatch": "账号身份不匹配", "login_required": "需要重新登录",
    },
    "file": {
        "final.json": "任务结论文件", "result.json": "任务原始结果", "截图": "证据截图",
        "过程文本": "过程文本", "其他": "其他过程文件",
    },
}

# Fallback texts.
OTHER = "其他"
UNKNOWN = "未知"
UNKNOWN_SOURCE = "未知来源"
UNDECIDED = "待判定"
DONE = "已完成"
TO_VERIFY = "待核实"
UNNAMED_TASK = "未命名任务"
NO_VALUE = "—"
NO_TEXT = "-"

# Verdict labels of the board and of the risk section.
VERDICT = {"risk": "有风险", "none": "未发现", "open": "待判定"}
FOUND = {"yes": "是", "no": "否", "open": "待判定"}

# Carrier kinds in listing order.
CARRIER_KINDS = ["web", "mapp", "app", "kapp"]

# The phase that each section of a company falls back to.
SECTION_PHASE = {
    "icp": "WEB_ICP", "website": "WEB_CRAWL", "social": "ACCOUNT_VERIFY",
    "risk": "RISK_ANALYSIS",
}

# Task statuses that the audit counts.
AUDIT_STATUSES = ["FAILED", "RETRY_WAIT", "RUNNING", "PENDING"]

# Analysis modes.
MODE_MODEL = "llm"
MODE_FALLBACK = "conservative_local_fallback"

# Review statuses, and the decision of a review that names none.
REVIEWED = "已复核"
PENDING_REVIEW = "待复核"
DEFAULT_DECISION = "采纳"

# Account decisions and official statuses.
ACCOUNT_OPEN = "待复核"
ACCOUNT_FOREIGN = "非官方"
ACCOUNT_OWN = "疑似官方"
UNCERTIFIED = "未认证"

# Evidence grades, source types, file kind of screenshots.
VERIFIED, PARTIAL, UNAVAILABLE = "verified", "partial", "unavailable"
EVIDENCE_LABEL = {"verified": "已验证", "partial": "部分/仅摘录"}
EVIDENCE_MISSING = "数据缺失"
SOURCE_TYPES = ["authoritative", "official_site", "social", "news"]
EXCERPT_ONLY_TYPE = "social"
SCREENSHOT = "截图"
# Fixed value: an excerpt with this text says that nothing was found.
EMPTY_MARK = "empty"

# Risk wording seen in the domain.
RISK_WORDS = ["高息回购", "保本", "到期兑付", "上门回收", "当场结算", "高价"]

# Wording that published text must not hold, by rule.
FORBIDDEN_WORDING = {
    "return_promise": ["承诺收益", "保证收益", "稳赚", "保本保息"],
    "trade_advice": ["建议买入", "建议卖出", "立即买入", "立即卖出"],
    "price_forecast": ["必涨", "必跌", "目标价"],
}

# Local zone of times written without one.
LOCAL_ZONE = "Asia/Shanghai"
