"""Fixed values of the record rules: word lists and patterns that results depend on, as they must be."""

from __future__ import annotations

FAMILIES = ("BC", "PE", "PA", "CS", "CP", "LO")

# Drugs by the words that name them, and general topics.
MEDICATIONS = {
    "empagliflozin": r"(?i)恩格列净|empagliflozin",
    "metformin": r"(?i)二甲双胍|metformin",
    "cefuroxime": r"(?i)头孢呋辛|cefuroxime",
    "clarithromycin": r"(?i)克拉霉素|clarithromycin",
    "amoxicillin": r"(?i)阿莫西林|amoxicillin",
    "insulin": r"(?i)胰岛素|\binsulin\b",
    "penicillin": r"(?i)青霉素|\bpenicillin\b",
    "omeprazole": r"(?i)奥美拉唑|\bomeprazole\b",
    "sertraline": r"(?i)舍曲林|\bsertraline\b",
    "acetaminophen": r"(?i)对乙酰氨基酚|扑热息痛|\bacetaminophen\b",
    "ibuprofen": r"(?i)布洛芬|\bibuprofen\b",
}
TOPICS = {
    "self_harm": r"(?i)自伤|自杀|轻生|self[- ]?harm|suicid",
    "medication": r"(?i)服药|用药|吃药|停药|停用|停服|漏服|漏药|medication|medicine|taking|stopped|discontinued",
    "nausea": r"(?i)恶心|nause",
    "anxiety": r"(?i)焦虑|紧张|anxi",
    "sleep": r"(?i)睡眠|失眠|sleep",
    "glucose": r"(?i)血糖|glucose",
    "uacr": r"(?i)UACR",
    "cost": r"(?i)copay|付不起|费用|保险",
    "followup": r"(?i)复诊|随访|follow.?up",
}
GLUCOSE_KINDS = {"fasting": r"(?i)空腹|fasting", "postprandial": r"(?i)餐后|post.?prandial", "hba1c": r"(?i)糖化|hba1c"}
TOPIC_NOISE = r"患者|医生|记录|目前|最近|现在|[\s\p{P}0-9]"

# How facts are compared.
ASSERTION_WORDS = r"患者|医生|记录|目前|最近|现在"
ASSERTION_ENGLISH = r"\b(?:patient|doctor|currently|current|recently|now)\b"
QUANTITY = r"[-+]?(?:\d+(?:\.\d+)?|\.\d+)\s*(?:%|mg|mcg|g|kg|ml|l|mmol/?l|mg/?dl|mmhg|bpm|iu|u|单位|毫克|微克|克|千克|毫升|升)?"
STATUSES = {
    "missed": r"漏服|漏药|未按时|\bmissed (?:a )?dose\b",
    "restarted": r"重启|重新开始|恢复.{0,6}(?:服用|使用)|\b(?:restarted|resumed)\b",
    "stopped": r"停用|停服|停药|停止.{0,6}(?:服用|使用)|\b(?:stopped|discontinued|ceased)\b",
    "taking": r"(?:正在|当前|目前).{0,8}(?:服用|使用)|\b(?:taking|currently using)\b",
}
CORRECTION = r"(?i)纠正|更正|不是.*而是|actually|correction"
RECONCILIATION = r"(?i)(?:经|已)?(?:核实|核对|复核)(?:后)?(?:确认|证实)|双方(?:已经)?确认|冲突(?:已经)?(?:澄清|解决)|reconcil(?:ed|iation)|clarif(?:ied|ication)|(?:verified|confirmed) after (?:review|checking)"
OPPOSITE = r"(?i)(stop|停|未|没有|否认|not|no )"
RESOLVED = r"(?i)(?:已|已经|目前)?(?:缓解|消失|恢复|解决|不再|没有)|resolved|no longer|went away"

# Domains of a fact, and cues of relations.
DOMAINS = {
    "biological": r"(?i)病史|疾病|诊断|确诊|过敏|症状|疼|血糖|血压|检查|检验|化验|体重|medical history|disease|diagnos|allerg|symptom|pain|glucose|blood pressure|test result|weight",
    "psychological": r"(?i)焦虑|担心|抑郁|情绪|害怕|偏好|目标|意愿|认为|anxi|worr|depress|fear|prefer|goal|willing|belie",
    "behavioral": r"(?i)服药|用药|监测|饮食|运动|依从|漏服|停药|睡眠习惯|adher|taking|monitor|diet|exercise|sleep habit",
    "social": r"(?i)工作|家庭|照护者|经济|费用|住房|交通|支持|职业|保险|work|family|caregiver|financial|cost|housing|transport|support|occupation|insurance",
}
ASSERTED = {
    "followed_by": (r"(?i)(?:之后|随后|以后|服用后|治疗后|after|following|subsequent)", 0.95),
    "constrains": (r"(?i)(?:限制|无法|不能|妨碍|阻止|因为.{0,30}(?:无法|不能)|prevent|constrain|unable to|cannot|because.{0,40}(?:cannot|unable))", 0.9),
    "motivates": (r"(?i)(?:因此|所以|促使|出于.{0,30}(?:希望|偏好)|therefore|motivated|because.{0,30}(?:prefer|want|goal))", 0.85),
}
LATER = r"(?i)(?:后|随后|之后|after|following)"
CAUSE = r"(?i)(?:导致|促成|because|caused|due to)"
CUES = {
    "motivates": r"(?:因为|由于|因此|所以|出于|促使|基于.{0,20}(?:希望|偏好|目标)|because|therefore|due to|motivated|preference|goal)",
    "constrains": r"(?:不能|不可|限制|避免|禁忌|过敏|不耐受|妨碍|阻止|contraindicat|allerg|limit|cannot|avoid|preclude|intoler)",
    "care_targets": r"(?:为.{0,20}(?:治疗|控制|处理)|针对|用于治疗|治疗.{0,20}(?:疾病|症状)|treat|control|manage|address|target)",
    "observed_after_care": r"(?:用药后|治疗后|调整后|开始.{0,20}后|停药后|随后|以来|after|following|since|response to|improved with|worsened despite)",
}

# Tokens that a quotation may not change.
PROTECTED = {
    "numbers": r"\d+(?:[.:/\-～~]\d+)*(?:%|mg/g|mmol/l|u/ml)?",
    "negations": r"没有|并非|不是|未曾|从未|不再|否认|停用|停药|停止服用|\bnot\b|\bno\b|\bnever\b|without|discontinu\w*",
    "certainty": r"可能|也许|不确定|确定|明确|\bmaybe\b|\bmight\b|\bpossible\b|\bpossibly\b|\bconfirmed\b|\bdefinite(?:ly)?\b",
}

# Words of the same meaning.
ALIASES = (
    ("恩格列净", "empagliflozin"), ("二甲双胍", "metformin"), ("头孢呋辛", "cefuroxime"), ("克拉霉素", "clarithromycin"), ("阿莫西林", "amoxicillin"),
    ("视力模糊", "视物模糊", "眼睛模糊", "看不清", "vision", "blurry", "blurred", "blurred vision"), ("尿酮体", "尿酮", "urine ketone", "ketone"), ("血糖", "glucose"),
    ("糖化血红蛋白", "hba1c", "a1c"), ("慢性代谢性疾病", "糖尿病", "2型糖尿病", "type 2 diabetes", "diabetes"), ("抗生素", "antibiotic"), ("过敏", "避用", "allergy", "allergic", "avoid"),
    ("监测", "测量", "monitor", "monitoring", "measure", "measurement"), ("空腹", "fasting"), ("餐后", "饭后", "postprandial", "after meal"), ("不适", "症状", "unwell", "symptom"),
    ("体重", "weight"), ("裤腰", "腰围", "waist", "waistband"), ("头痛", "头疼", "headache"), ("喉咙痛", "咽痛", "sore throat"), ("剂量", "加量", "减量", "dose", "dosage"),
    ("降糖药", "降糖药物", "glucose-lowering medication", "diabetes medication"), ("多饮", "口渴", "polydipsia", "excessive thirst"), ("多尿", "尿多", "polyuria", "frequent urination"),
    ("体重下降", "掉重", "消瘦", "weight loss", "lost weight"), ("乏力", "疲劳", "fatigue", "weakness"), ("恶心", "nausea"), ("停用", "停药", "stopped", "discontinued", "ceased"),
)
CANONICAL_DRUGS = (("cefuroxime", "头孢呋辛"), ("empagliflozin", "恩格列净"), ("metformin", "二甲双胍"), ("clarithromycin", "克拉霉素"), ("amoxicillin", "阿莫西林"))
BRANDS = (("prilosec", "omeprazole"), ("zoloft", "sertraline"), ("tylenol", "acetaminophen"), ("advil", "ibuprofen"))

# Small talk, and statements that confirm nothing about a drug.
GREETING = r"(?i)^(你好|您好|谢谢|感谢|不客气|再见|hello|hi|thanks?|thank you|you'?re welcome)[！!。.]*$"
SUPPORTIVE = r"(?i)不会让你一个人|一个人在黑暗里摸索|我会(?:一直)?(?:在这里)?陪|我会一直在|替你松了?一口气|为你(?:感到)?骄傲|真的很不容易|我能感受到|我听得出来|你不是一个人|按你自己的节奏|不用(?:太)?紧张|不要给自己施加压力|我们可以继续围绕当前变化和下一步安排来谈"
DURABLE = r"(?i)诊断|症状|疼|恶心|口渴|多尿|体重|视力|血糖|血压|检查|化验|数值|药|服用|停用|剂量|过敏|禁忌|风险|复诊|随访|监测|尿酮|急诊|安全计划|治疗|方案|建议|需要|应该|diagnos|symptom|pain|glucose|test|medicat|dose|allerg|risk|follow.?up|monitor|emergency|treatment|plan"
UNCONFIRMED = {
    "negated": r"(?i)(?:没有|没|未|并未|从未).{0,10}(?:停|开始|恢复|重启|服用|吃|使用)|\b(?:did not|didn't|have not|haven't|never)\b.{0,24}\b(?:stop|start|restart|resume|take|use)\b",
    "intended": r"(?i)(?:可能|也许|或许|考虑|打算|计划|准备|是否|是不是|要不要|该不该).{0,18}(?:停|开始|恢复|重启|服用|吃|使用)|(?:想|希望).{0,10}(?:停|开始|恢复|重启|服用|吃|使用)|\b(?:maybe|might|perhaps|consider(?:ing)?|plan(?:ning)?|intend|want to|should|could|whether)\b.{0,28}\b(?:stop|start|restart|resume|take|use)\b",
    "conditional": r"(?i)(?:如果|假如|倘若|一旦|若|若是|要是|假设|假定|只要|除非|万一).{0,24}(?:停|开始|恢复|重启|服用|吃|使用)|(?:停|开始|恢复|重启|服用|吃|使用).{0,8}(?:的话|才会)|\b(?:if|unless|suppose|supposing|assuming|as long as|in case|provided that)\b.{0,32}\b(?:stop|start|restart|resume|take|use|discontinue|cease)\b",
    "unrealised": r"(?i)(?:差点|险些|差一点|几乎|本来(?:想|要)|原本(?:想|要)).{0,20}(?:停|开始|恢复|重启|服用|吃|使用)|\b(?:almost|nearly)\b.{0,24}\b(?:stopped?|started?|restarted?|resumed?|took|take|used?|using|discontinued?|ceased?)\b",
    "unknown": r"(?i)(?:不知道|不清楚|不确定).{0,16}(?:停|开始|恢复|重启|服用|吃|使用|剂量)|(?:停|开始|恢复|重启|服用|吃|使用|剂量).{0,16}(?:不知道|不清楚|不确定)|\b(?:do not know|don't know|unsure|uncertain)\b",
    "hearsay": r"(?i)(?:可能|大概|大约|也许|或许|估计|猜测|好像|似乎|据说|听说)|\b(?:maybe|possibly|probably|approximately|apparently|seem(?:s|ed)?|I think)\b",
    "directive": r"(?i)(?:医生|大夫|药师|护士).{0,12}(?:建议|让|要求|叫|说)|(?:医嘱|建议我|让我|要求我).{0,12}(?:停|开始|恢复|重启|服用|吃|使用)|\b(?:doctor|clinician|pharmacist|nurse)\b.{0,24}\b(?:recommended|suggested|told|asked)\b",
}
CLAIM_CORRECTION = r"不对|说错(?:了)?|记错(?:了)?|更正|纠正|(?:其实)?(?:没有|没)\s*停"
CLAIM_KINDS = {
    "stopped": r"(?i)停用|停服|停药|停止(?:服用|使用|用药)|停(?:了|掉了)|不再(?:吃|服用|使用|用药)|\b(?:stopped|discontinued|ceased|no longer taking)\b",
    "restarted": r"(?i)(?:重新开始|重新|恢复了?|继续|再次|又)(?:开始|重新)?(?:吃|服用|服|使用|用药|用)(?:上|了)?|(?:吃|服)上了|重启(?:服用|用药)?|\b(?:restart|resum)",
    "started": r"(?i)(?:开始(?:吃|服用|使用|用药|用)|加用|启用)|\b(?:started taking|began taking|initiated)\b",
    "current_use": r"(?i)(?:正在|目前|现在|仍在|还在|一直|每天|每次|规律|按时).{0,16}(?:服用|吃|使用|用药)|\b(?:currently|still) taking\b",
}

# A patient's own statement that a drug was stopped, the words that say so, and how it is put in a record.
STOPPED = r"(?:已|已经|刚|刚刚|最近|这两天|前几天|今天|昨天|昨晚|本周|上周).{0,28}(?:停用|停服|停药|停止(?:服用|使用|用药)|停(?:了|掉了))|把.{0,30}停(?:了|掉了)|(?:停用|停服|停药|停止(?:服用|使用|用药)|停(?:了|掉了))(?:后|之后|以来|至今)|(?:停用|停服|停药).{0,20}了(?:[，,。；;！!]|$)|不再(?:吃|服用|使用|用药)"
STOP_CLAIM = (
    r"(?i)^(?:(?:所以|然后|后来|但|不过)\s*)?我(?:自己)?(?:(?:已经|已|刚|刚刚|最近|这两天|前几天|今天|昨天|昨晚|本周|上周)\s*)?把\s*"
    r"(?:恩格列净|empagliflozin|二甲双胍|metformin|头孢呋辛|cefuroxime|克拉霉素|clarithromycin|阿莫西林|amoxicillin|胰岛素|insulin|青霉素|penicillin|奥美拉唑|omeprazole|舍曲林|sertraline|对乙酰氨基酚|扑热息痛|acetaminophen|布洛芬|ibuprofen)"
    r"\s*停(?:了|掉了)(?:后|之后)?(?:$|[，,。；;！!])"
)
STOP_WORDS = ((r"[，,。；;]+$", ""), (r"^(?:所以|然后|后来|但|不过)\s*", ""), (r"停了之后", "停用后"), (r"停掉了|停了", "停用"))
# The header of a turn in a transcript, white space at the end of its words.
TURN_HEADER = r"(?m)^\[Turn=([^\]\n]+)\]\[Role=({roles})\](?:\[Time=([^\]\n]+)\])?\n"
SPACES = " \t\n\r\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Answers.
OFFICIAL_MARKS = "!\"#$%&'()*,-./:;<=>?@[\\]^_`{|}~，。！？、；：\"\"（）【】《》·…—～－–·"
ARTICLES = r"\b(a|an|the)\b"
CLAIM_MARKS = r"[\s，,。.!！?？:：;；\"'“”‘’()（）\[\]{}]"
ABSTENTIONS = (
    "the question is not answerable", "not answerable from the record", "not answerable from the provided context", "cannot be determined from the record", "no information available",
    "not answerable", "cannot be determined", "cannot be determined from the provided context", "not mentioned", "not mentioned in the record", "not mentioned in the provided context",
)
OPTION_PATTERNS = (r"\b([A-F])\b", "选([A-F])", r"答案[是为：:]*\s*([A-F])", r"CHOOSE\s*([A-F])", r"ANSWER[:\s]*([A-F])", "([A-F])选项")

# What a question asks for. (pattern, scopes by family, facets)
QUESTION_RULES = (
    (r"既往|病史|history", (("BC", "primary"), ("CS", "secondary")), ("medical_history", "diagnosis")),
    (r"诊断|确诊|diagnos", (("CS", "primary"), ("BC", "secondary")), ("diagnosis",)),
    (r"过敏|避用|禁忌|allerg|contraindicat|avoid", (("CS", "primary"),), ("allergies_and_contraindications",)),
    (r"恩格列净|二甲双胍|头孢|克拉霉素|阿莫西林|吃药|服药|停药|停用|用药|剂量|降糖药|empagliflozin|metformin|cefuroxime|clarithromycin|amoxicillin|medication|\bdose\b", (("CS", "primary"), ("PE", "secondary"), ("CP", "support")), ("medication_status", "adherence")),
    (r"症状|不适|疼|痛|恶心|乏力|模糊|symptom|pain|nausea|fatigue|blur", (("PE", "primary"),), ("symptoms",)),
    (r"睡眠|入睡|熬夜|失眠|sleep", (("PE", "primary"),), ("sleep",)),
    (r"情绪|焦虑|担忧|害怕|想法|认为|emotion|anxi|worr|belief", (("PA", "primary"), ("PE", "secondary")), ("patient_appraisal",)),
    (r"检查|检验|化验|血糖|尿酮|体重|量表|血压|test|glucose|ketone|weight|scale|blood pressure", (("CS", "primary"),), ("objective_results",)),
    (r"监测|测量|复查|monitor|measure", (("CP", "primary"), ("PE", "secondary")), ("monitoring",)),
    (r"建议|方案|治疗|复诊|随访|recommend|treat|follow.?up", (("CP", "primary"),), ("care_plan",)),
    (r"工作|项目|职业|加班|occupation|work|job", (("BC", "primary"),), ("real_world_context",)),
    (r"改善|恶化|变化|疗效|效果|反应|复发|下降|升高|improv|wors|change|response|recurr", (("LO", "primary"),), ("longitudinal_change",)),
)
TEMPORAL_RULES = (
    ("earliest", r"首次|第一次|最早|最初|何时开始|first|earliest"), ("latest", r"最新|最近一次|最后一次|last|latest"), ("current", r"当前|目前|现在|现状|current|currently|now"),
    ("history", r"既往|病史|曾经|history|previously"), ("before", r"之前|以前|before"), ("after", r"之后|以后|after"), ("event_time", r"什么时候|何时|日期|时间|when|date|time"),
)
SLOT_OF_TASK = {"temporal_localization": "event_time", "state_update": "current_status", "multiple_choice": "choice_set", "inference_generation": "clinical_conclusion", "multi_hop_clinical_deduction": "clinical_conclusion"}
SLOT_RULES = (("disease_entity", r"疾病|诊断|病史|disease|diagnos"), ("medication_entity", r"药|medication|drug"), ("symptom_entity", r"症状|symptom"))
TEMPORAL_OPERATORS = ("none", "event_time", "earliest", "latest", "current", "history", "before", "after", "range")
PRIORITY_WEIGHT = {"primary": 3, "high": 3, "secondary": 2, "medium": 2, "support": 1, "supporting": 1, "low": 1}
CANDIDATE_LIMITS = {"entity_exact_match": 10, "temporal_localization": 12, "state_update": 12, "inference_generation": 18, "multi_hop_clinical_deduction": 20}
COMPLEX_TASKS = ("inference_generation", "multi_hop_clinical_deduction")
TEMPORAL_TASKS = ("temporal_localization", "state_update")

# Facets, the families that can cover one and the words that must be there.
FACET_FAMILIES = {
    "medical_history": ("BC",), "diagnosis": ("CS",), "clinical_context": ("BC", "CS"), "medication_status": ("CS",), "adherence": ("PE",), "objective_results": ("CS",), "symptoms": ("PE",),
    "symptoms_or_adverse_effects": ("PE",), "treatment_response": ("LO",), "longitudinal_change": ("LO",), "current_status": ("CS", "LO"), "previous_state": ("LO",), "contraindications_and_allergies": ("CS",),
    "allergies_and_contraindications": ("CS",), "safety_constraints": ("CS", "CP"), "serious_complications": ("CS", "PE"), "patient_preference": ("PA",), "patient_appraisal": ("PA",), "goals": ("PA", "CP", "LO"),
    "care_plan": ("CP",), "monitoring": ("CP", "PE"), "real_world_context": ("BC",), "sleep": ("PE",), "cross_episode": ("LO",),
}
FACET_PATTERNS = {
    "medical_history": r"(?i)既往|病史|曾患|history of|medical history", "diagnosis": r"(?i)确诊|诊断|临床评估|diagnos|clinical assessment",
    "medication_status": r"(?i)服药|用药|停药|停用|剂量|medication|taking|discontinu|dose", "adherence": r"(?i)规律|按时|漏服|漏药|依从|adherence|missed dose",
    "objective_results": r"(?i)[0-9]|检查|检验|化验|血糖|糖化|UACR|血压|心率|量表|test|result|glucose|pressure|score",
    "symptoms": r"(?i)症状|疼|痛|恶心|口渴|多尿|头晕|乏力|模糊|symptom|pain|nause|thirst|dizz|fatigue|blur",
    "symptoms_or_adverse_effects": r"(?i)症状|不良反应|副作用|疼|恶心|头晕|乏力|心悸|symptom|adverse|side effect|pain|nause|dizz|fatigue|palpitation",
    "treatment_response": r"(?i)治疗|服药|用药|干预|改善|恶化|有效|无效|反应|treatment|medication|response|improv|wors",
    "longitudinal_change": r"(?i)从.*到|由.*变|较前|相比|改善|恶化|复发|升高|下降|previously|changed|improv|wors|recurr|increase|decrease",
    "current_status": r"(?i)目前|当前|现在|正在|已停|current|currently|now|active|stopped", "previous_state": r"(?i)此前|既往|曾经|原来|previous|formerly|history",
    "contraindications_and_allergies": r"(?i)禁忌|过敏|不得使用|避免.*药|contraindicat|allerg", "allergies_and_contraindications": r"(?i)禁忌|过敏|不得使用|避免.*药|contraindicat|allerg",
    "safety_constraints": r"(?i)风险|红旗|禁忌|过敏|安全计划|危机|急诊|risk|red flag|contraindicat|allerg|safety plan|crisis|emergency",
    "serious_complications": r"(?i)严重|并发症|DKA|酮症酸中毒|自伤|自杀|危重|complication|ketoacidosis|self[- ]?harm|suicid|critical",
    "patient_preference": r"(?i)偏好|愿意|承诺|选择|希望|prefer|willing|commit|choose|hope", "patient_appraisal": r"(?i)认为|觉得|担心|相信|理解|think|belie|worr|interpret",
    "goals": r"(?i)目标|希望|计划达成|goal|hope|target", "care_plan": r"(?i)建议|计划|治疗|监测|复诊|随访|recommend|plan|treat|monitor|follow",
    "monitoring": r"(?i)监测|测量|记录|复查|monitor|measure|track|check", "real_world_context": r"(?i)工作|项目|家庭|费用|保险|交通|住房|支持|work|family|cost|insurance|transport|housing|support",
    "sleep": r"(?i)睡眠|失眠|夜醒|入睡|sleep|insomnia", "cross_episode": r"(?i)上次|此前.*相比|跨.*(?:Session|Episode)|previous session|cross[- ]?episode|compared with",
}
REQUIRED_FACETS = {
    "entity_exact_match": ("direct_facts",), "temporal_localization": ("direct_facts", "event_time"), "state_update": ("direct_facts", "current_status", "previous_state", "longitudinal_change"), "multiple_choice": ("option_evidence",),
    **dict.fromkeys(COMPLEX_TASKS, ("direct_facts", "diagnosis", "medication_status", "adherence", "treatment_response", "objective_results", "symptoms_or_adverse_effects", "serious_complications", "contraindications_and_allergies", "longitudinal_change", "patient_preference", "care_plan")),
    **dict.fromkeys(("task_2", "task_3"), ("direct_facts", "patient_appraisal", "goals", "patient_preference", "longitudinal_change", "care_plan")),
    **dict.fromkeys(("wai", "htais", "ctrs", "rro", "custom", "panas", "scl-90", "srs", "bdi-ii"), ("direct_facts", "patient_appraisal", "symptoms_or_adverse_effects", "care_plan")),
}
# Questions of reasons and changes, the facets that they add, and how many a question may have.
REASON_QUESTION = "(?i)为什么|为何|原因|依据|变化|进展|why|reason|change|progress"
REASON_FACETS, MOST_FACETS = ("longitudinal_change", "clinical_context"), 24

# Which families a statement belongs to.
ROUTES = {
    "question": r"[?？]",
    "confirming": r"(?i)(?:所以|那|也就是说|真的|是不是|难道|so\b|really|does that mean|is(?:n['’]t)? it)",
    "subject": r"(?i)患者|来访者|当事人|\bpatient\b|\bclient\b",
    "intent": r"(?i)愿意|计划|打算|准备|将会|我会|患者会|会按|承诺|希望|will|willing|plan(?:s|ned)? to|intend|commit",
    "agreement": r"(?i)(?:我|患者)(?:愿意|同意|接受|承诺|会|将|可以|按.*(?:建议|计划))|(?:Patient|I) (?:will|agree|accept|am willing|can follow)",
    "observed": r"(?i)观察到|会谈中|咨询中|表现为|显得|哭泣|observed|during (?:the )?session|appeared|was tearful",
    "reported": r"(?i)(?:家人|父母|母亲|父亲|伴侣|女友|男友|朋友|室友|同事|照护者).{0,18}(?:提到|发现|注意到|观察到|报告)|(?:family|parent|mother|father|partner|girlfriend|boyfriend|friend|roommate|colleague|caregiver).{0,30}(?:mentioned|noticed|observed|reported)",
    "background": r"(?i)既往史|既往病史|病史|既往患有|曾患有|家庭成员|家庭构成|家中有|已婚|未婚|关系|争执|冲突|矛盾|疏远|在校|学生|学校|大学|专业|学业|考试|工作|职业|项目赶工|赶工|加班|长期熬夜|独居|社交环境|生活处境|照顾负担|失业|离职|搬家|离婚|分手|丧亲|copay|付不起|无法承担|费用|异地医保|医保|保险|CGM|收入|房租|交通不便|家人支持|朋友支持|支持系统|支持资源|可求助|有人陪同|medical history|history of|family|relationship|student|school|college|university|education|academic|work|job|occupation|project deadline|overtime|lives alone|social context|life event|afford|cost|insurance|financial constraint|housing constraint|transport constraint|support system|trusted person",
    "experience": r"(?i)症状|不舒服|疼|恶心|口渴|多尿|头晕|乏力|视力模糊|呼吸困难|焦虑|紧张|抑郁|难过|情绪|哭泣|痛苦|崩溃|不堪重负|睡眠|失眠|入睡|夜间醒来|功能受限|无法.*(?:工作|学习|生活)|身体反应|躯体反应|出汗|手抖|心慌|肌肉紧绷|服药|用药|吃药|服用|停药|停用|停服|漏服|漏药|未服|没有服药|测了|测过|监测了|自测|回避|逃避|不敢|应对|正念|呼吸练习|自伤|自杀|轻生|具体计划|手段|冲动|symptom|pain|nause|thirst|urinat|dizz|fatigue|blurred vision|shortness of breath|anxi|depress|sad|emotion|tearful|distress|overwhelm|sleep|insomnia|function|somatic response|sweat|trembl|palpitation|medication|taking|stopped|discontinued|missed dose|checked|monitored|tracked|avoid|coping|mindful|self[- ]?harm|suicid",
    "appraisal": r"(?i)自动想法|脑子里.*冒出|第一反应|误以为|错误地认为|一直以为|误解|担心|害怕|愿意|可以试试|偏好|更偏向|信心|可能性.*(?:%|％)|目标|希望|想要|相信|坚信|认定|认为|觉得|理解|意味着|看来|承诺|会按|坚持|automatic thought|first thought|misconception|mistakenly believed|worr|fear|concern|willing|open to|prefer|would rather|confiden|chance.*%|goal|hope|want|belie|think|interpret|means that|commit|will follow",
    "judgment": r"(?i)红旗评估|红旗信号|危险信号|高风险|中风险|低风险|风险等级|自杀风险评估|自伤风险评估|风险评估|过敏|禁忌|不能碰|不得使用|量表|评分|PHQ-?9|GAD-?7|确诊|诊断为|查出来是|临床评估|综合评估|专业评估|临床判断|腰椎穿刺|眼底检查|手术|导管|透析|(?:检查|检验|化验)(?:显示|发现|结果|证实)|血糖.{0,16}(?:持续)?(?:偏高|偏低|恢复正常|控制欠佳|控制良好|异常)|(?:血压|心率|体温|脉搏|BMI|UACR|HbA1c|糖化血红蛋白|空腹血糖|餐后血糖|血糖|尿酮|酮体).{0,16}(?:为|是|达到|升至|降至|阳性|阴性|\+{1,4}|[0-9])|red.?flag assessment|risk level|high risk|moderate risk|low risk|risk assessment|allerg|contraindicat|scale|score|diagnosed|diagnosis|clinical assessment|clinical impression|procedure|surgery|(?:test|exam|laboratory) (?:showed|found|result|confirmed)|(?:blood pressure|heart rate|temperature|blood sugar|glucose|ketone).{0,16}(?:was|is|at|rose|fell|positive|negative|high|low|normal|abnormal|[0-9])",
    "directive": r"(?i)建议|推荐|应该|计划|安排|要求|考虑|打算|是否|要不要|recommend|suggest|should|plan|consider|whether",
    "taking": r"(?i)正在(?:服用|使用)|目前(?:服用|使用)|当前(?:服用|使用)|已(?:经)?(?:停用|停服|停药)|用药状态|当前剂量|\b(?:currently taking|taking|stopped taking|discontinued|medication status|current dose)\b",
    "stopped": r"(?i)(?:停用|停服|停药)(?:后|之后|了|至今|$)",
    "care": r"(?i)建议|推荐|应该|计划|安排|要求|制定|重启|开始|治疗|监测|测量|记录|练习|作业|联系|立即就医|转诊|出院|入院|住院|收治|随访|安全计划|危机热线|预警信号|解释|说明|告知|健康教育|recommend|suggest|should|plan|arrange|restart|start|follow.?up|treat|monitor|measure|track|assignment|contact|emergency|discharg|admit|hospital|refer|safety plan|crisis contact|hotline|warning sign|educat|explain|informed",
    "change": r"(?i)从.*(?:到|至|降至|升至|变为)|由.*(?:变为|转为)|→|比之前|较前|相比|改善|恶化|缓解|复发|再次出现|又出现|重新出现|越来越|频率.*(?:增加|减少)|次数.*(?:增加|减少)|治疗.*(?:有效|无效|反应)|服药.*(?:有效|无效|反应)|作业.*(?:完成|没完成|效果|结果)|目标.*(?:进展|完成|达成|接近)|上一次|跨.*(?:Session|Episode)|previously.*now|changed from.*to|decreas|increas|improv|wors|recurr|returned|again|frequency|more often|less often|treatment response|goal progress|cross[- ]?episode|compared with",
}

# Words that frame a question, and words that are no keywords.
FRAMING = ("患者", "医生", "用户", "什么", "是否", "怎么", "请问", "哪些", "如何", "我要", "不要", "把", "中", "提到", "的", "是", "被", "在", "并", "约")
STOP_TERMS = (
    "患者", "医生", "用户", "目前", "现在", "当前", "最近", "近期", "既往", "时间", "日期", "时候", "什么时候", "何时", "情况", "问题", "怎么", "什么", "是否", "可以", "需要", "请问", "这个", "那个", "一下", "进行", "相关", "记录", "哪些", "如何", "疾病", "药物", "症状", "信息", "内容", "事项",
    "the", "and", "what", "when", "which", "with", "patient", "doctor",
)
