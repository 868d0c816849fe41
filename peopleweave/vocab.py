"""Default vocabularies. All are plain parameters of the operators and can be replaced.

Fixed values: every list, label and pattern in this file has to equal the published
behaviour for results to agree.
"""

# --- sources -----------------------------------------------------------------
PROFILE_SOURCE = "bonjour"      # source A: profile pages
CODE_SOURCE = "github"          # source B: code hosting
WEB_SOURCE = "web"
SOURCES = [PROFILE_SOURCE, CODE_SOURCE, WEB_SOURCE]
SOURCE_LABELS = {"bonjour": "Bonjour", "github": "GitHub", "web": "Web"}
PROFILE_URL_PREFIX = "https://bonjour.bio/"

EVIDENCE_TYPES = ["social", "project", "repository", "community_post", "job_signal", "education", "experience",
                  "profile_field", "summary"]
EVIDENCE_WEIGHTS = {"project": 24, "repository": 22, "experience": 16, "job_signal": 14, "community_post": 12,
                    "education": 10, "social": 8, "profile_field": 5, "summary": 5}
COMPARISON_PRIORITY = {"project": 0, "repository": 1, "experience": 2, "job_signal": 3, "profile_field": 4,
                       "social": 5}
LINK_PRIORITY = {"project": 0, "repository": 1, "experience": 2}

# --- text normalisation --------------------------------------------------------
UNIVERSITY_FAMILIES = [["zhejiang university", "zju", "浙江大学", "浙大"]]
FULL_WIDTH_FROM = "！？，。；：（）【】《》“”‘’｜－　"
FULL_WIDTH_TO = "!?,.;:()[]<>\"\"''|- "

# --- query understanding ---------------------------------------------------------
EXPERIENCE_HINTS = ["intern", "junior", "mid", "senior", "staff", "lead", "principal", "founder"]
OPEN_SOURCE_TERMS = ["open source", "open-source", "开源"]
OPEN_SOURCE_QUERY_TERMS = ["open source", "开源"]
TECH_LEAD_TERMS = ["tech lead", "technical lead", "技术负责人", "负责人", "lead"]
SPECIALIZED_TERMS = ["rag", "retrieval", "检索", "multimodal", "multi-modal", "多模态", "computer vision",
                     "计算机视觉", "llm"]
SHORT_TECH_TERMS = ["rag", "llm", "nlp", "cv"]
WEAK_MUST_HAVE = [r"(^|[^A-Za-z0-9_])github($|[^A-Za-z0-9_])", r"(^|[^A-Za-z0-9_])bonjour($|[^A-Za-z0-9_])",
                  r"(^|[^A-Za-z0-9_])active($|[^A-Za-z0-9_])", "recently active", "活跃"]
ROLE_HINTS = {
    "builder": ["builder", "构建者", "开发者"],
    "tech lead": ["tech lead", "technical lead", "技术负责人"],
    "engineer": ["engineer", "工程师"],
    "researcher": ["researcher", "研究员", "研究者"],
    "scientist": ["scientist", "科学家"],
    "founder": ["founder", "创始人", "联合创始人", "co-founder", "cofounder"],
    "cto": ["cto"],
    "product manager": ["product manager", "product", "pm", "产品经理"],
    "designer": ["designer", "设计师", "视觉设计"],
    "manager": ["manager", "经理"],
    "developer": ["developer", "开发者"],
}
SKILL_HINTS = {
    "python": ["python"], "typescript": ["typescript"], "javascript": ["javascript"], "rust": ["rust"],
    "go": ["go"], "java": ["java"], "pytorch": ["pytorch"], "tensorflow": ["tensorflow"],
    "machine learning": ["machine learning", "ml"], "deep learning": ["deep learning"], "rag": ["rag"],
    "llm": ["llm", "大模型"], "nlp": ["nlp", "自然语言处理"], "agent": ["agent", "智能体"],
    "ai": ["ai", "人工智能"], "backend": ["backend", "后端"],
    "infra": ["infra", "infrastructure", "系统优化", "devops"],
    "multimodal": ["multimodal", "multi-modal", "多模态"],
    "computer vision": ["computer vision", "cv", "计算机视觉"], "retrieval": ["retrieval", "检索"],
    "open source": ["open source", "open-source", "开源"],
}
UNIVERSITY_HINTS = {"zhejiang university": ["浙大", "zju", "zhejiang university"]}
UNIVERSITY_CITY = "hangzhou"
PLACE_HINTS = ["beijing", "shanghai", "shenzhen", "hangzhou", "guangzhou", "china", "singapore", "remote",
               "北京", "上海", "深圳", "杭州", "广州", "中国", "新加坡", "远程"]
MUST_HAVE_PATTERNS = [r"must have ([^,.;]+)", r"required ([^,.;]+)", r"need ([^,.;]+)", r"with ([^,.;]+) experience"]
NICE_TO_HAVE_PATTERNS = [r"nice to have ([^,.;]+)", r"prefer ([^,.;]+)"]
ROLE_FAMILIES = {
    "tech lead": ["tech lead", "technical lead", "技术负责人", "负责人"],
    "engineer": ["engineer", "工程师", "ai工程师", "后端工程师"],
    "backend engineer": ["backend engineer", "backend", "后端", "后端工程师", "工程师"],
    "developer": ["developer", "开发者", "工程师"],
    "founder": ["founder", "创始人", "联合创始人", "co-founder", "cofounder"],
    "researcher": ["researcher", "研究员", "研究者", "ai研究员"],
    "scientist": ["scientist", "科学家"],
    "product manager": ["product manager", "product", "pm", "产品经理"],
    "designer": ["designer", "设计师", "视觉设计"],
    "manager": ["manager", "经理"],
}
SKILL_FAMILIES = {
    "machine learning": ["machine learning", "ml"],
    "backend": ["backend", "后端"],
    "infra": ["infra", "infrastructure", "系统优化", "devops"],
    "multimodal": ["multimodal", "multi-modal", "多模态"],
    "computer vision": ["computer vision", "cv", "计算机视觉"],
    "retrieval": ["retrieval", "检索"],
    "open source": ["open source", "open-source", "开源"],
    "agent": ["agent", "智能体"],
    "ai": ["ai", "人工智能"],
    "llm": ["llm", "大模型"],
    "rag": ["rag"],
    "nlp": ["nlp", "自然语言处理"],
}
LOCATION_FAMILIES = {
    "hangzhou": ["杭州", "hangzhou"], "beijing": ["北京", "beijing"], "shanghai": ["上海", "shanghai"],
    "shenzhen": ["深圳", "shenzhen"], "guangzhou": ["广州", "guangzhou"], "china": ["中国", "china"],
    "singapore": ["新加坡", "singapore"],
}

# --- condition extraction from refine text ----------------------------------------
REFINE_SKILLS = ["python", "java", "go", "rust", "typescript", "javascript", "pytorch", "tensorflow", "rag", "llm",
                 "cuda", "vllm"]
REFINE_PLACES = ["杭州", "上海", "北京", "深圳", "广州", "remote", "远程", "hangzhou", "shanghai", "beijing",
                 "shenzhen", "guangzhou"]
REFINE_ROLES = ["本科生", "学生", "后端", "前端", "python工程师", "工程师", "researcher", "engineer", "backend",
                "frontend"]
REFINE_MUST = [r"必须会?([^，。；;\n]+)", r"一定要([^，。；;\n]+)", r"must have ([^,.;]+)", r"required ([^,.;]+)"]
REFINE_NICE = [r"最好([^，。；;\n]+)", r"优先([^，。；;\n]+)", r"加分项?[：: ]?([^，。；;\n]+)", r"prefer ([^,.;]+)"]
REFINE_EXCLUDE = [r"不要([^，。；;\n]+)", r"排除([^，。；;\n]+)", r"去掉([^，。；;\n]+)", r"exclude ([^,.;]+)",
                  r"without ([^,.;]+)"]
REFINE_FRESH = "最近|近期|活跃|最新|fresh|recent|active"
SCHOOL_PATTERN = r"(?i)浙大|浙江大学|(^|[^A-Za-z0-9_])zju($|[^A-Za-z0-9_])|zhejiang university"
STUDENT_PATTERN = "本科生|学生|在读|就读"
SCHOOL_ALIASES = ["浙大", "浙江大学", "zju", "zhejiang university"]
STUDENT_TERMS = ["本科生", "学生", "在读", "就读"]
SKIPPED_QUERY_VALUES = ["不限", "skip", "none"]

# --- preferences --------------------------------------------------------------------
PREFERENCE_TECH = ["python", "rust", "java", "typescript", "javascript", "go", "golang", "c++", "cpp", "c#",
                   "csharp", "kotlin", "swift", "ruby", "php", "react", "vue", "angular", "node", "django",
                   "flask", "spring", "tensorflow", "pytorch", "cuda", "llm", "ai", "ml"]
PREFERENCE_CITIES = ["杭州", "北京", "上海", "深圳", "广州", "成都", "南京", "武汉", "苏州", "西安", "长沙", "天津",
                     "重庆", "厦门", "青岛"]
PREFERENCE_ROLES = [("backend", "后端|backend"), ("frontend", "前端|frontend"), ("algorithm", "算法|algorithm"),
                    ("fullstack", "全栈|fullstack"), ("data", r"数据|data\s*engineer"),
                    ("ai", r"ai\s*工程师|ai\s*engineer"), ("ml", r"机器学习|ml\s*engineer")]
PREFERENCE_FRESH = ["最近活跃", "要新鲜", "prefer fresh", "preferfresh", "活跃的"]
REASON_TO_PREFERENCE = {"experience_mismatch": "avoidInexperience", "not_active": "avoidInactive"}

# --- document index -------------------------------------------------------------------
TECH_KEYWORDS = ["python", "javascript", "typescript", "rust", "go", "java", "kotlin", "swift", "machine learning",
                 "ai", "deep learning", "nlp", "rag", "llm", "gpt", "transformer", "react", "vue", "angular",
                 "svelte", "node", "next.js", "django", "flask", "docker", "kubernetes", "aws", "gcp", "azure",
                 "tensorflow", "pytorch", "cuda"]
ROLE_FIELDS = ["role", "current_doing", "skill", "bio"]
PLACE_SUFFIX = "(省|市|区|县|自治区|特别行政区)$"
SEED_TAG = "zju_manual_seed"
DIRECTION_PREFIX = "direction:"
ROLE_NOISE = "(looking for|open to work|we are hiring|hiring|招聘|招募|寻找|求职)"
ROLE_NOISE_SEGMENT = "合作伙伴"
B = r"(?<![A-Za-z0-9_])"
E_ = r"(?![A-Za-z0-9_])"
STRONG_TITLE = (r"(co[- ]?founder|founder|联合创始人|创始人|合伙人|" + B + "partner" + E_ + "|investor|" + B + "vc" + E_
                + "|投资人|产品经理|product manager|" + B + "pm" + E_
                + r"|designer|设计师|engineer|工程师|developer|开发者|独立开发者|researcher|研究员|sales|销售|顾问"
                r"|consultant|student|学生|creator|创作者|aigcer|运营|operations?|后端|frontend|全栈|full[- ]?stack)")
AI_DOMAIN = ("(aigc|ai" + E_ + "|agent|rag|llm|gpt|machine learning|deep learning|" + B + "ml" + E_
             + "|智能体|大模型|模型|算法|ai infra|infra|neocloud)")
RESEARCH_SIGNAL = "(researcher|research|研究员|研究|scientist)"
EXPLICIT_RESEARCHER = "(researcher|研究员|scientist)"
ENGINEER_SIGNAL = "(engineer|工程师|研发)"
DEVELOPER_SIGNAL = ("(developer|开发者|builder|独立开发者|indie hacker|independent developer"
                    "|网站开发|应用开发|软件开发)")
INDEPENDENT_SIGNAL = "(独立开发者|indie hacker|independent developer)"
PRODUCT_SIGNAL = "(product manager|产品经理|" + B + "pm" + E_ + ")"
OPERATIONS_SIGNAL = "(运营|operations?|operator|品牌运营|商业化运营|社区运营)"
GROWTH_SIGNAL = "(growth|增长)"
SIMPLE_ROLES = [
    ("合伙人", "(合伙人|" + B + "partner" + E_ + ")"),
    ("投资人", "(investor|投资人|投资分析|" + B + "vc" + E_ + "|venture capital)"),
    ("产品经理", PRODUCT_SIGNAL),
    ("设计师", "(designer|设计师|品牌设计|" + B + "ux" + E_ + "|" + B + "ui" + E_ + "|视觉设计)"),
    ("运营", OPERATIONS_SIGNAL),
    ("销售", "(sales|商务|销售|" + B + "bd" + E_ + "|business development)"),
    ("顾问", "(consultant|advisor|顾问)"),
    ("讲师", "(teacher|lecturer|讲师|导师)"),
    ("学生", "(student|中学生|学生)"),
    ("创作者", "(creator|创作者|aigcer|podcaster|播客主|视频创作|内容创作)"),
]
ROLE_SIGNAL_PATTERN = (r"(?i)(co[- ]?founder|founder|联合创始人|创始人|合伙人|partner|investor|" + B + "vc" + E_
                       + "|投资|产品经理|product manager|" + B + "pm" + E_
                       + r"|backend|frontend|full[- ]?stack|后端|前端|全栈|engineer|工程师|developer|开发者|开发"
                       r"|researcher|研究|研究员|designer|设计|运营|operations?|sales|销售|consultant|顾问|讲师"
                       r"|teacher|student|学生|creator|创作者|aigcer|agent|rag|llm|ai" + E_ + "|智能体|infra|增长)")
JOB_SIGNALS = ["open-to-work", "open_to_work", "open to work", "we-are-hiring", "we_are_hiring", "we are hiring"]
ENRICH_EXCLUDED_HOSTS = ["github.com", "twitter.com", "jike.com", "xiaohongshu.com"]
COMPANY_KEYWORDS = ["founder", "engineer", "developer", "designer", "product"]

# --- directions --------------------------------------------------------------------------
DIRECTIONS = [
    ("ai_agents", "AI agents", [B + "agentic" + E_, B + "agents?" + E_, B + "multi-agent" + E_, "智能体"]),
    ("ai_infra", "AI infra", [B + "ai infra" + E_, B + "inference" + E_, B + "serving" + E_, B + "llmops" + E_,
                              B + "vllm" + E_, B + "cuda" + E_, "基础设施", "推理", "模型部署"]),
    ("developer_tools", "Developer tools", [B + "developer tools?" + E_, B + "devtools?" + E_, B + "tooling" + E_,
                                            "开发者工具", B + "sdk" + E_]),
    ("education", "Education", [B + "edtech" + E_, B + "education" + E_, "教育", "学习", "智能教育"]),
    ("enterprise_ai", "Enterprise AI", [B + "enterprise ai" + E_, B + "b2b" + E_, B + "enterprise automation" + E_,
                                        "企业ai", "企业服务", "自动化", "workflow automation"]),
    ("open_source", "Open source", [B + "open source" + E_, B + "oss" + E_, "开源"]),
    ("robotics", "Robotics", [B + "robotics?" + E_, B + "embodied" + E_, "机器人"]),
    ("healthcare", "Healthcare", [B + "healthcare" + E_, B + "medical" + E_, B + "biomed", "医疗", "生物医药"]),
    ("fintech", "Fintech", [B + "fintech" + E_, B + "trading" + E_, B + "quant" + E_, "金融科技", "支付"]),
    ("creator_media", "Creator media", [B + "creator" + E_, B + "content" + E_, B + "community" + E_, "内容创作",
                                        "播客", "社区"]),
]
DIRECTION_FIELDS = ["bio", "current_doing", "role", "skill", "focus", "project_focus", "about", "summary"]
DIRECTION_EVIDENCE = ["profile_field", "project", "repository", "community_post", "experience", "job_signal",
                      "education", "summary"]

# --- reasons that count towards match strength ----------------------------------------------
SUBSTANTIVE_PREFIXES = ["技术命中：", "必须项满足：", "角色贴合：", "经验层级贴合：", "检索技能命中：",
                        "检索必须项命中：", "检索角色命中：", "相关证据：", "相关项目：", "role match:",
                        "skill evidence:", "must-have matched:", "project:"]
SUBSTANTIVE_EXACT = ["语义相似度高", "关键词重合度高", "strong semantic similarity", "strong keyword overlap"]
SUPPORTIVE_PREFIXES = ["地点命中：", "来源过滤命中：", "近期活跃："]
