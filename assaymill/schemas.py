"""Fixed values of the domain: enumerations, weights, label maps, word lists and thresholds."""

from __future__ import annotations

# Kinds of testable statements, priorities and their weights, and statuses.
STATEMENT_TYPES = ["definition", "rule", "prohibition", "threshold", "process", "metric", "exception", "formula", "date", "change"]
PRIORITY_WEIGHT = {"P0": 5, "P1": 3, "P2": 1}
PUBLISHABLE = ["quality_verified", "governance_passed", "user_confirmed", "published"]
REVIEW_STATUSES = ["candidate", "needs_review", "needs_revision", *PUBLISHABLE, "blocked", "retired"]
VERSION_STATUSES = ["draft", "frozen", "published"]
COMPOSITION_SOURCES = ["doc_generated", "uploaded", "public"]
CHECK_TYPES = ["answerability", "faithfulness", "uniqueness", "evidence_sufficiency", "question_relevance"]
HARD_CHECKS = ["answerability", "faithfulness", "question_relevance"]
UPLOAD_EXTENSIONS = [".txt", ".md", ".pdf", ".docx", ".xlsx", ".csv"]
UNFILED, NO_DOCUMENT = "未分类", "未关联文档"

# Limits.
MAX_STATEMENT, MAX_MERGE, MAX_FILE_BYTES = 200, 1200, 50 * 1024 * 1024
MAX_TABLE_ROWS, MAX_TABLE_CELLS, MAX_ERRORS, PAGE = 100_000, 500_000, 20, 200
GATE_WEIGHTED, GATE_P0, GATE_BLOCKS, PASS_SCORE, DEDUP_COSINE, REUSE_COSINE = 0.85, 1.0, 1.0, 0.5, 0.90, 0.92

# Words of transition lines that carry no statement.
SKIP_WORDS = [
    "见上文", "见下文", "详见", "见附件", "如表", "如下表", "如下图", "见图", "（完）", "（续）", "承前", "接上页",
    "以下略", "以下同", "页眉", "页脚", "目录", "引用本文", "本节导读", "本章导读",
]

# The patterns of each statement type in the order of the rules, with its priority.
NUMBER_UNIT = r"\d[\d,.]*(?:%|％|万元|亿元|元|个|户|笔|人|天|个月|年|倍)?"
RULES = [
    ("prohibition", "P0", [r"^(?:禁止|严禁|不准|不允许|不得)|禁止|严禁"]),
    ("exception", "P0", [r"除非|除外|例外|可放宽|可不(?:受|适用|按|计)|但(?:是)?.{0,6}(?:可以|允许|不受)"]),
    (
        "threshold",
        "P0",
        [
            r"(?:不超过|不得超过|不得低于|不得高于|不得少于|不低于|不高于|上限|下限|控制在|最高|最低)\s*" + NUMBER_UNIT + "|" + NUMBER_UNIT
            + r"\s*(?:以上|以下|不超过|不得超过|不得低于|不得高于|不得少于|不低于|不高于)"
        ],
    ),
    ("date", "P1", [r"(?:\d{4}年\d{1,2}月\d{1,2}日|\d{1,2}月\d{1,2}日).{0,10}(?:施行|生效|执行|实施|截止)|(?:自|从).{0,12}(?:起施行|起生效|起实施)"]),
    ("formula", "P1", [r"=|公式|除以|乘以|计算方式"]),
    ("definition", "P1", [r"是指|系指|指.{0,4}(?:而言|的)|定义为|定义如下|包括.{0,12}(?:等|几类|下列)"]),
    ("rule", "P1", [r"应(?:当|该|按|于|及时|优先|在|自|从|提供|取得)|必须|须(?:经|在|于|按|取得|报)|原则上|要求.{0,4}(?:满足|符合|执行|遵守)"]),
    ("process", "P1", [r"流程|步骤|依次|顺序|先后|先.{0,8}(?:再|然后).{0,8}(?:后|最终)|办理程序"]),
    ("metric", "P2", [r"\d[\d,]*(?:\.\d+)?\s*(?:万元|亿元|元|户|笔|人|%)", r"达到|为|计|累计|总额|余额|金额|人数|户数|增长率|净利润|营业收入"]),
    ("change", "P1", [r"调整(?:为|至|到)?|修订|改版|新版|旧版|由.{0,10}(?:改为|调整为|变更为|提高|降低)|较.{0,4}(?:版|年度)"]),
]

#: Statement types whose rules may hold for texts without a Chinese character.
RULES_OF_ANY = ["formula"]

# What constraints are read from.
UNITS = ["万元", "亿元", "元", "%", "％", "倍", "人", "户", "笔", "天", "个月"]
CURRENCIES = ["人民币", "美元", "欧元", "港币", "日元"]
CONDITION = r"(.{2,30}?(?:时|的|的情况下|条件下|如果|当))"
#: One of these stands wherever ``CONDITION`` finds something.
CONDITION_WORDS = ["时", "的", "条件下", "如果", "当"]
SUBJECT = r"^([^，,。；;]{2,18}?(?:公司|银行|企业|单位|机构|贷款人|借款人|支行|客户|小微企业|担保机构|员工))"

# Signs that question keys ignore, and full-width signs with their half-width forms.
QUESTION_SIGNS = "，。？、；：,.?!;:\"'“”‘’（）()【】[]·…—-_/\\~`@#$^&*+=<>|"
WIDE, NARROW = "０１２３４５６７８９．，；：！？（）％", "0123456789.,;:!?()%"

# Advice by diagnosis code, and display labels.
ADVICE = {
    "D1": "文档解析失败：检查解析器版本 / OCR 质量，修复表格结构与版面定位后重抽",
    "D2": "知识表示失败：补充术语表 / 指标口径，检查 EIU 拆分与关系",
    "D3": "检索召回失败：优化切块 / 查询理解 / 召回策略，检查 EIU 向量索引",
    "D4": "排序 / 上下文失败：调优重排、邻居扩展、上下文预算",
    "D5": "答案生成失败：优化提示词 / 模型 / 引用约束，检查证据是否完整进入上下文",
    "D6": "评测样本缺陷：修订题目 / 金标准 / 证据后发布新版本（m05 编辑）",
    "D7": "原始材料不足：改为拒答 / 补充资料 / 移出评测集",
    "D8": "安全策略失败：检查脱敏与提示注入防护规则",
    "D9": "系统运行异常：检查超时 / 限流 / 接口错误，重试或调整适配器配置",
}
NO_ADVICE = "建议人工复核该失败样本"
#: Types of statements that together make a question across segments, in either order.
COMPLEMENTS = [("definition", "formula"), ("definition", "metric"), ("metric", "formula"), ("rule", "exception"), ("rule", "change")]
HARD_TYPES = ["threshold", "definition", "rule", "prohibition", "exception"]

# Settings that are never stored, and what stands for absent texts.
SECRETS = ["api_key"]
DASH, JOINT, NO_SECTION, NO_STATUS, UNREVIEWED, NO_REASON = "—", "；", "（无章节）", "未解析", "待审核", "未说明排除原因"
STATUS_LABELS = {"completed": "已解析", "failed": "解析失败", "parsing": "解析中", "pending": "待解析"}
DIFFICULTY_LABELS = {"L1": "简单", "L2": "中等", "L3": "难", "L4": "难"}
REVIEW_LABELS = {"quality_verified": "已通过", "approved": "已通过", "rejected": "已驳回", "blocked": "已阻断"}
TYPE_LABELS = {"rule": "规则", "constraint": "约束", "definition": "定义", "process": "流程"}
PRIORITY_LABELS = {"P1": "必须覆盖", "P2": "建议覆盖", "P3": "可选覆盖"}
PURPOSE_LABELS = {"basic": "基础问题", "gen": "泛化问题"}
QA_HEADER = ["问题", "答案", "难度", "证据", "来源文档"]
CSV_COLUMNS = ["case_id", "question", "gold_answer", "type", "scope", "difficulty", "content_priority", "review_status"]
CONSTRAINT_KEYS = ["subject", "condition", "scope", "period", "currency", "unit"]

# Limits of requests.
MAX_CONSTRAINT_BYTES, MAX_REASON, LEAST_ANSWER, PAGER = 16 * 1024, 128, 8, 15
MAX_PDF_PAGES, MAX_DOCX_ELEMENTS = 500, 200_000

# Texts of exports and reports.
CASE_KIND, CASE_LEVEL, CASE_PRIORITY, CASE_STATUS = "- 题型: ", " / 难度: ", " / 优先级: ", " / 状态: "
CASE_ANSWER, CASE_POINTS, CASE_PLACE = "- 标准答案: ", "- 必须命中要点:", "- 证据定位: "
REPORT_HEAD = "# 质量校验报告\n\n- 参与校验样本：%d\n- 通过：%d / 失败：%d\n"
UPLOADED_FILE = "上传文件"

#: Units of numbers and what they stand for; phrases by which an answer declines.
UNIT_FACTORS = {"%": 0.01, "‰": 0.001, "千": 1e3, "万": 1e4, "百万": 1e6, "千万": 1e7, "亿": 1e8, "万亿": 1e12, "k": 1e3, "thousand": 1e3, "million": 1e6, "bn": 1e9, "billion": 1e9}
REFUSALS = ["无法回答", "不能回答", "无法确定", "没有相关信息", "资料中未提及", "cannot answer", "can't answer", "unable to answer", "no information", "not mentioned in the"]
