"""Traditional tables and wordings that results must carry, in their natural order."""

# fixed values: the cycle of ten and of twelve
STEMS = list("甲乙丙丁戊己庚辛壬癸")
BRANCHES = list("子丑寅卯辰巳午未申酉戌亥")
ELEMENTS = list("木火土金水")
ANIMALS = list("鼠牛虎兔龙蛇马羊猴鸡狗猪")
BRANCH_ELEMENTS = list("水土木木土火火土金金土水")
HIDDEN_STEMS = ["癸", "己癸辛", "甲丙戊", "乙", "戊乙癸", "丙戊庚", "丁己", "己丁乙", "庚壬戊", "辛", "戊辛丁", "壬甲"]
MELODIC = ["海中金", "炉中火", "大林木", "路旁土", "剑锋金", "山头火", "涧下水", "城头土", "白蜡金", "杨柳木", "泉中水", "屋上土", "霹雳火", "松柏木", "长流水", "砂中金", "山下火", "平地木", "壁上土", "金箔金", "佛灯火", "天河水", "大驿土", "钗钏金", "桑柘木", "大溪水", "沙中土", "天上火", "石榴木", "大海水"]  # two days each
STEM_TABOOS = ["甲不开仓财物耗散", "乙不栽植千株不长", "丙不修灶必见灾殃", "丁不剃头头必生疮", "戊不受田田主不祥", "己不破券二比并亡", "庚不经络织机虚张", "辛不合酱主人不尝", "壬不泱水更难提防", "癸不词讼理弱敌强"]
BRANCH_TABOOS = ["子不问卜自惹祸殃", "丑不冠带主不还乡", "寅不祭祀神鬼不尝", "卯不穿井水泉不香", "辰不哭泣必主重丧", "巳不远行财物伏藏", "午不苫盖屋主更张", "未不服药毒气入肠", "申不安床鬼祟入房", "酉不会客醉坐颠狂", "戌不吃犬作怪上床", "亥不嫁娶不利新郎"]

# fixed values: the calendar
LUNAR_MONTHS = ["正月", "二月", "三月", "四月", "五月", "六月", "七月", "八月", "九月", "十月", "冬月", "腊月"]
LUNAR_DAYS = ["初一", "初二", "初三", "初四", "初五", "初六", "初七", "初八", "初九", "初十", "十一", "十二", "十三", "十四", "十五", "十六", "十七", "十八", "十九", "二十", "廿一", "廿二", "廿三", "廿四", "廿五", "廿六", "廿七", "廿八", "廿九", "三十"]
OFFICERS = list("建除满平定执破危成收开闭")
MANSIONS = list("角亢氐房心尾箕斗牛女虚危室壁奎娄胃昴毕觜参井鬼柳星张翼轸")
SOLAR_TERMS = ["立春", "雨水", "惊蛰", "春分", "清明", "谷雨", "立夏", "小满", "芒种", "夏至", "小暑", "大暑", "立秋", "处暑", "白露", "秋分", "寒露", "霜降", "立冬", "小雪", "大雪", "冬至", "小寒", "大寒"]
SOLAR_TERM_DAYS = [4, 19, 5, 20, 5, 20, 5, 21, 6, 21, 7, 23, 8, 23, 8, 23, 8, 23, 7, 22, 7, 22, 6, 20]
SIGNS_OF_ZODIAC = ["摩羯座", "水瓶座", "双鱼座", "白羊座", "金牛座", "双子座", "巨蟹座", "狮子座", "处女座", "天秤座", "天蝎座", "射手座"]
SIGN_FIRST_DAYS = [20, 19, 21, 20, 21, 22, 23, 23, 23, 24, 23, 22]
WOMB_PLACES = ["占门碓外东南", "占厨灶炉外东南", "占门床外东南", "占房床外东南", "占门碓厕外东南", "占厨灶门外东南", "占碓磨门外东南", "占厕户外东南", "占门鸡栖外东南", "占房床栖外东南", "占门碓外东南", "占厨灶炉外东南", "占仓库门外东南", "占房床厕外东南", "占门碓厨外东南", "占厨灶碓外东南", "占碓磨厕外东南", "占厕户碓外东南", "占门鸡栖碓外东南", "占房床碓外东南", "占仓库碓外东南", "占房床厨外东南", "占门碓磨外东南", "占厨灶磨外东南", "占碓磨门外东南", "占厕户门外东南", "占门鸡栖门外东南", "占房床门外东南", "占仓库门外东南", "占房床户外东南"]
CLASH_DIRECTIONS = ["北", "南", "东", "西", "东北", "西北", "东南", "西南"]
COLOURS = ["红色", "黄色", "绿色", "蓝色", "紫色", "白色", "粉色"]
DIRECTIONS = ["东方", "南方", "西方", "北方", "东南", "西南", "东北", "西北"]
LUCK_LEVELS = ["大凶", "小凶", "中等", "吉", "大吉"]
ACTIVITIES = ["嫁娶", "安葬", "搬家", "开业", "出行", "动土", "祭祀", "就医", "入学", "投资"]
SUITABLE = "祈福 求嗣 开光 塑绘 斋醮 订盟 纳采 嫁娶 裁衣 合帐 冠笄 进人口 安床 沐浴 剃头 整手足甲 入殓 移柩 启钻 安葬 立碑 除服 成服 入学 习艺 出行 起基 定磉 放水 移徙 入宅 竖柱上梁 开市 立券 纳财 酝酿 开池 栽种 牧养 纳畜 破土 修坟 谢土 赴任 会亲友 求医 治病 词讼 竖柱 上梁 开仓 出货财 开渠 穿井".split()
TABOO = "嫁娶 安床 开光 出行 栽种 安葬 破土 启钻 除服 成服 移徙 入宅 出火 纳采 订盟 会亲友 上官赴任 临政亲民 结网 酝酿 开市 立券 纳财 开仓 出货财 修造 动土 竖柱上梁 修门 作灶 放水 开池 牧养 纳畜 修坟 立碑 谢土 祈福 求嗣 斋醮 塑绘 整手足甲 沐浴 理发 探病 针灸 出师 畋猎 取渔 举网 入学 求医 余事勿取".split()
GOOD_SPIRITS = "天德 月德 天德合 月德合 天恩 天愿 月恩 天赦 天福 月空 岁德 鸣犬 守日 天巫 福德 六合 五富 圣心 益后 续世 除神 月财 禄库 四相 时德 民日 三合 临日 时阳 生气 神在 母仓 月仓 分金 满德 守护 解神 天马 驿马 天后 天巫 要安 玉堂 金匮 金柜".split()
BAD_SPIRITS = "月破 大耗 灾煞 天火 四废 四忌 四穷 五墓 复日 重日 时阴 死神 月煞 月虚 血支 天贼 五虚 土府 归忌 血忌 月厌 地火 四击 大时 大败 咸池 朱雀 白虎 天空 玄武 勾陈 螣蛇 四方藏 往亡 招摇 九空 九坎 九焦 厌对 招摇 九丑 四离 四绝 月建 小耗".split()

# fixed values: trigrams by their lines from the bottom (a solid line is 1) and hexagrams by upper and lower trigram
TRIGRAMS = list("乾坤震巽坎离艮兑")
TRIGRAM_LINES = ["111", "000", "100", "011", "010", "101", "001", "110"]
TRIGRAM_ELEMENTS = list("金土木木水火土金")
ORDER_EARLY = list("乾兑离震巽坎艮坤")
ORDER_SIX_LINE = list("坤震坎兑艮离巽乾")
HEXAGRAMS = [
    "乾为天 天地否 天雷无妄 天风姤 天水讼 天火同人 天山遁 天泽履",
    "地天泰 坤为地 地雷复 地风升 地水师 地火明夷 地山谦 地泽临",
    "雷天大壮 雷地豫 震为雷 雷风恒 雷水解 雷火丰 雷山小过 雷泽归妹",
    "风天小畜 风地观 风雷益 巽为风 风水涣 风火家人 风山渐 风泽中孚",
    "水天需 水地比 水雷屯 水风井 坎为水 水火既济 水山蹇 水泽节",
    "火天大有 火地晋 火雷噬嗑 火风鼎 火水未济 离为火 火山旅 火泽睽",
    "山天大畜 山地剥 山雷颐 山风蛊 山水蒙 山火贲 艮为山 山泽损",
    "泽天夬 泽地萃 泽雷随 泽风大过 泽水困 泽火革 泽山咸 兑为泽",
]
PALACES = [
    "乾为天 天泽履 天火同人 天雷无妄 天风姤 天水讼 天山遁 天地否",
    "坤为地 地雷复 地泽临 地天泰 地山谦 地水师 地火明夷 地风升",
    "震为雷 雷地豫 雷水解 雷风恒 雷火丰 雷天大壮 雷山小过 雷泽归妹",
    "巽为风 风天小畜 风火家人 风雷益 风水涣 风地观 风山渐 风泽中孚",
    "坎为水 水泽节 水雷屯 水火既济 水天需 水地比 水山蹇 水风井",
    "离为火 火山旅 火风鼎 火水未济 火地晋 火天大有 火泽睽 火雷噬嗑",
    "艮为山 山火贲 山天大畜 山泽损 山雷颐 山风蛊 山水蒙 山地剥",
    "兑为泽 泽水困 泽地萃 泽山咸 泽雷随 泽火革 泽天夬 泽风大过",
]
LINE_BRANCHES = ["子寅辰午申戌", "未巳卯丑亥酉", "子寅辰午申戌", "丑亥酉未巳卯", "寅辰午申戌子", "卯丑亥酉未巳", "辰午申戌子寅", "巳卯丑亥酉未"]
LINE_SYMBOLS = ["━ ━", "━━━", "━ ━ ×", "━━━ ○"]  # broken, solid, broken and moving, solid and moving
SPIRITS = ["青龙", "朱雀", "勾陈", "腾蛇", "白虎", "玄武"]
SPIRIT_OF_STEM = [0, 0, 1, 1, 2, 3, 4, 4, 5, 5]
SIX_KIN = ["兄弟", "子孙", "妻财", "官鬼", "父母"]
TEN_GODS = ["比肩", "食神", "正财", "正官", "正印"]
BODY_USE = ["比和", "生", "克", "被克", "被生"]
LESSON_KIN = ["比肩", "食神", "财星", "官杀", "印绶"]
RELATION_TEXTS = ["世应同气，关系和谐", "世生应，我方有利于对方", "世克应，我方占上风", "应克世，对方占上风", "应生世，对方有利于我"]
QUESTION_KINDS = [("官鬼", "工作 事业 官 职"), ("妻财", "财 钱 收入 投资"), ("父母", "考试 学习 文书 合同"), ("子孙", "子女 孩子 下属 晚辈"), ("兄弟", "朋友 兄弟 姐妹 同事"), ("妻财", "婚姻 恋爱 感情 配偶")]
MOVING_TEXTS = ["无动爻，以本卦静断", "独发一爻，以此爻断。", "二爻齐动，以上爻为主。两爻相互作用，需观察生克关系。", "三爻皆动，以中爻为主。变化较大，事态复杂。", "多爻齐动，以静爻为主。变化极大，需要谨慎。"]
PLUM_VERDICTS = ["体用比和，平顺之象，事情发展平稳，按部就班即可。", "体生用，耗费之象，事情需要付出努力方可成功。", "体克用，可成之象，但需要主动出击，掌握主动权。", "用克体，受制之象，事情困难重重，需谨慎行事。", "用生体，得助之象，事情容易成功，有贵人相助。"]
PLUM_SUGGESTIONS = ["宜稳中求进，不急不躁，水到渠成。", "宜主动付出，以诚待人，功到自然成。", "宜果断行动，把握主动，速战速决。", "宜以柔克刚，避其锋芒，另寻他路。", "有贵人相助，宜把握机会，顺势而为。"]

# fixed values: what eight hexagrams mean (meaning, reading, career, wealth, marriage, health), and of the others
HEXAGRAM_TEXTS = {
    "乾为天": ("刚健中正，纯粹精神", "乾卦象征天，代表刚健、创造、领导。大吉大利，但要防止过刚则折。", "事业蒸蒸日上，适合担任领导职务", "财运亨通，投资有利", "男方占主导地位，需要宽容", "精神饱满，但要防止过度劳累"),
    "坤为地": ("厚德载物，包容万象", "坤卦象征地，代表柔顺、包容、承载。顺从天意，谦虚包容为上策。", "适合辅助工作，以和为贵", "财来慢而稳，积少成多", "女方占主导，家庭和睦", "体质稍弱，注意调养"),
    "水雷屯": ("万物始生，艰难创业", "屯卦象征初生，如同种子萌芽。创业维艰，但前景光明。", "新事业开始，困难重重但有希望", "初期投资需谨慎，后期有收获", "感情处于萌芽期，需要培养", "身体恢复期，需要耐心调理"),
    "山水蒙": ("启蒙教育，童蒙求学", "蒙卦象征蒙昧，需要启发教育。求学问道，谦虚请教为宜。", "需要学习提升，请教前辈", "理财知识不足，需要学习", "对感情认识不够，需要了解", "对健康知识缺乏，多咨询医生"),
    "水天需": ("等待时机，积蓄力量", "需卦象征等待，如云聚天空待降雨。时机未到，需要耐心等待。", "暂时等待，时机成熟再行动", "投资时机未到，继续观望", "感情需要时间发展，不要急躁", "病情稳定，继续治疗"),
    "天水讼": ("争讼纠纷，化解矛盾", "讼卦象征争执，天与水方向相反。有纠纷冲突，宜和解不宜强争。", "职场有争议，以和为贵", "财务纠纷，寻求调解", "感情有争执，需要沟通", "身体不适，及时就医"),
    "地水师": ("统兵作战，纪律严明", "师卦象征军队，地下有水源。组织严密，纪律严明，能够获胜。", "团队协作，听从指挥", "集体投资，规划有序", "家庭和睦，各司其职", "系统治疗，遵医嘱"),
    "水地比": ("亲密团结，相辅相成", "比卦象征亲近，水润泽大地。团结合作，相互扶助，大吉。", "同事和睦，合作愉快", "合伙投资，互利共赢", "感情深厚，相依相伴", "家人关心，恢复顺利"),
}
HEXAGRAM_DEFAULTS = ("待查", "此卦需要详细分析", "事业运势需要结合具体情况分析", "财运情况需要结合爻位分析", "感情状况需要看用神旺衰", "健康状况需要观察疾病用神")
HEXAGRAM_SUGGESTIONS = [("吉", "卦象吉利，可以大胆行动"), ("困", "目前遇到困难，需要耐心等待")]
CLASSIC_HEXAGRAMS = [(1, "乾卦", "☰", "元亨利贞", "乾卦象征天，代表刚健、积极、创造的力量。君子应当自强不息。"), (2, "坤卦", "☷", "元亨，利牝马之贞", "坤卦象征地，代表柔顺、包容、承载的品德。君子应当厚德载物。"), (3, "屯卦", "☲", "元亨利贞，勿用有攸往", "屯卦象征初生，事物刚刚开始，充满困难但也充满希望。")]

# fixed values: what trigrams stand for, in the order of TRIGRAMS
LIKENESS = {
    "nature": ["天、太阳、君、父、夫、大人、老人、长者、官贵", "地、阴云、雾气、妇人、母、后、妻、腹、臣民", "雷、电、虹、地震、火山", "风、木、草、花", "水、雨、雪、露、霜、泉", "火、日、电、霓虹、霞", "山、土、石、云、雾", "泽、雨、池、井泉"],
    "body": ["头、骨、肺", "腹、脾、胃、肉", "足、肝、发、声音", "股、肱、胆、气", "耳、血、肾", "目、心、上焦", "手、指、背、鼻", "口、齿、舌、肺"],
    "character": ["刚健、威严、豪迈、果断", "柔顺、吝啬、懦弱、众多", "动、怒、惊、躁、急", "柔和、不定、鼓舞、仁慈", "陷、隐伏、流动、聪明", "文明、发现、扩张、漂亮", "止、慎、守、迟", "喜悦、口舌、饮食、妾"],
    "object": ["金玉、珠宝、圆物、冠、镜", "布帛、文章、方物、柄、土瓦", "竹木、苇、乐器、花草繁鲜之物", "木、绳、直物、长物、工巧之物", "水具、酒器、圆物、轮、矢、盐", "火、书、文、印、兵戈、干燥物", "土石、瓜果、寺庙、床", "金刃、金类、乐器、废缺之物"],
    "animal": ["马、天鹅、狮、象", "牛、母马、百兽", "龙、蛇、鹰、百虫", "鸡、百禽、山林禽虫", "猪、鱼、水中物", "雉、龟、蟹、螺、蚌", "狗、鼠、虎、牛、狐", "羊、豕、鸟"],
    "time": ["秋、九十月之交、戌亥年月日时", "夏秋之交、六七月、未申年月日时", "春、二三月之交、卯年月日时", "春夏之交、三四月、辰巳年月日时", "冬、十一月、子年月日时", "夏、五月、午年月日时", "冬春之交、十二正月、丑寅年月日时", "秋、八月、酉年月日时"],
    "direction": ["西北", "西南", "东", "东南", "北", "南", "东北", "西"],
    "number": ["一、四、九", "二、五、八、十", "三、四、八", "三、四、五、八", "一、六", "二、三、七", "五、七、八、十", "二、四、九"],
    "color": ["大赤、金黄", "黄、黑", "青、绿、碧", "绿、青、白", "黑、赤", "赤、紫、红", "黄、紫", "白"],
    "taste": ["辛、辣", "甘、甜", "酸", "酸", "咸", "苦", "甘", "辛"],
}

# fixed values: four pillars
STEM_POLARITY = list("阳阴阳阴阳阴阳阴阳阴")
PERSONALITY = ["性格仁慈宽厚，富有同情心，喜欢帮助他人。做事有条理，注重计划性。", "性格热情开朗，积极向上，富有激情。行动力强，但有时过于急躁。", "性格稳重踏实，诚实守信，有责任心。做事谨慎，但有时过于保守。", "性格刚毅果断，讲究原则，重视公正。意志坚定，但有时过于固执。", "性格聪明机智，适应能力强，善于变通。思维敏捷，但有时缺乏定性。"]
LACKS = ["缺木，注意肝胆健康", "缺火，注意心脏血液循环", "缺土，注意脾胃消化", "缺金，注意肺部呼吸系统", "缺水，注意肾脏泌尿系统"]
ELEMENT_COLOURS = ["绿色、青色", "红色、紫色", "黄色、棕色", "白色、金色", "黑色、蓝色"]
ELEMENT_DIRECTIONS = ["东方", "南方", "中央", "西方", "北方"]
MARRIAGE = {"男": "妻星在日支，婚姻宫稳定，配偶贤惠顾家。宜选择性格温和、善解人意的伴侣。婚后生活和谐美满。", "女": "官星有力，容易遇到条件优秀的伴侣。夫妻感情深厚，相互扶持。宜选择事业心强、有责任感的伴侣。"}
CAREER = "官星有力，适合从事管理、行政类工作。财星生官，事业发展顺利，容易得到上级赏识。建议选择稳定的工作环境，循序渐进地发展。"
WEALTH = "财星在月柱，财运较好，赚钱能力强。正财偏财俱全，既有稳定收入，也有意外之财。理财宜稳健为主，避免高风险投资。"
PATTERN = "正官格"
HEALTH_TEXTS = ["五行较为平衡，身体健康状况良好。", "建议保持良好作息，适当运动，注意饮食均衡。"]
PILLAR_SUGGESTIONS = ["保持积极乐观的心态，顺势而为", "多行善积德，广结善缘", "注重学习提升，增强自身能力"]

# fixed values: nine palaces
PALACE_NAMES = ["坎宫", "坤宫", "震宫", "巽宫", "中宫", "乾宫", "兑宫", "艮宫", "离宫"]
PALACE_DIRECTIONS = ["北", "西南", "东", "东南", "中央", "西北", "西", "东北", "南"]
STARS = ["天蓬星", "天任星", "天冲星", "天辅星", "天禽星", "天心星", "天柱星", "天任星", "天英星"]
DOORS = ["休门", "死门", "伤门", "杜门", "中宫", "开门", "惊门", "生门", "景门"]
DEITIES = ["值符", "腾蛇", "太阴", "六合", "勾陈", "朱雀", "九地", "九天"]
PATTERNS = ["青龙返首", "白虎猖狂", "朱雀投江", "玄武当道", "勾陈得位", "腾蛇夭矫"]
PATTERN_LEVELS = ["大吉", "大凶", "凶", "凶", "平", "凶"]

PATTERN_TEXTS = ["青龙返首，贵人提携，大利求财求官", "白虎猖狂，血光之灾，宜退守避凶", "朱雀投江，口舌是非，文书不利", "玄武当道，盗贼暗害，出行不利", "勾陈得位，田土有关，宜守不宜攻", "腾蛇夭矫，虚惊怪异，精神不安"]
PATTERN_OTHER_TEXT = "当前格局较为平稳，宜根据九星八门的具体配置进行详细分析。"
LEVELS = ["大吉", "吉", "平", "凶", "大凶"]
LUCK_TEXTS = ["当前运势极佳，正是大展身手的好时机。各方面都有很好的发展机会，宜积极主动。", "当前运势较好，多数事情能够顺利进行。只要把握好时机，就能获得不错的成果。", "当前运势平稳，无大起大落。宜保持现状，稳扎稳打，不宜冒进。", "当前运势不佳，容易遇到阻碍和困难。宜低调行事，避免重大决策。", "当前运势极差，诸事不宜。应暂缓重要计划，注意防范风险。"]
LUCK_OTHER_TEXT = "当前运势处于变化之中，宜静观其变，适时而动。"
ASPECT_TEXTS = {  # good, bad, else
    "career": ("事业运势较好，有贵人相助，适合求职升迁。", "事业上可能遇到阻碍，需要谨慎处理人际关系。", "事业运势平稳，宜稳步发展，不宜急功近利。"),
    "wealth": ("财运不错，有获利机会，适合投资理财。", "财运欠佳，容易破财，需要节制开支。", "财运一般，收支基本平衡，宜量入为出。"),
    "love": ("感情运势良好，有望遇到心仪对象或关系更进一步。", "感情上可能有波折，需要多沟通理解。", "感情运势平稳，宜真诚相待，自然发展。"),
    "health": ("身体状况良好，精力充沛，适合锻炼养生。", "需要注意身体健康，避免过度劳累，预防意外。", "健康状况一般，宜注意作息规律，适度运动。"),
    "study": ("学业运势很好，思维敏捷，考试运佳。", "学习上可能遇到困难，需要加倍努力。", "学业运势一般，宜踏实学习，循序渐进。"),
}
PALACE_SUGGESTIONS = {  # by level; the first for both good levels, the second for both bad ones
    "吉": ("抓住当前的良好机会，积极行动", "可以考虑开展新的计划或项目", "与人交往宜主动，容易得到帮助"),
    "凶": ("暂缓重大决策，等待时机改善", "避免冲突和争执，以和为贵", "多做准备工作，厚积薄发"),
    "平": ("保持平和心态，顺应自然发展", "观察形势变化，适时调整策略", "注重内在修养，提升自身能力"),
}
HALF_DAY_TEXTS = ["上午时段较为有利，宜早起行动", "下午时段运势平稳，适合处理日常事务", "晚上时段宜休息静养，明日重新开始"]

# fixed values: twelve branches
GENERALS = ["贵人", "腾蛇", "朱雀", "六合", "勾陈", "青龙", "天空", "白虎", "太常", "玄武", "太阴", "天后"]
LESSON_TYPES = ["涉害", "遥克", "昴星", "重审", "元首", "知一"]
LESSON_LEVELS = ["凶", "凶", "吉", "平", "大吉", "吉"]

LESSON_TEXTS = ["涉足险地，多有损害", "远距离冲克，事多不顺", "昴宿照命，文昌发达", "事需重新审议，不可急进", "为众人之首，大权在握", "知机识变，处事明智"]
LESSON_LUCK = {"大吉": "此课大吉，诸事皆宜，是难得的好卦象。", "吉": "此课较吉，多数事情能够顺利进行。", "平": "此课平稳，宜守成，不宜冒进。", "凶": "此课有凶象，需要谨慎行事。"}
DAY_PART_TEXTS = ["当前为上午时段，阳气上升，适合开始新的计划。", "当前为中午时段，阳气最盛，宜处理重要事务。", "当前为下午时段，宜收尾整理，准备休息。", "当前为夜间时段，阴气较重，宜静思反省，不宜行动。"]

# fixed values: daily fortune
LOVE_ADVICE = ["今日桃花运佳，单身者有机会遇到心仪对象", "情侣间感情稳定，适合深入交流", "已婚者要多关心伴侣，避免冷战", "今日感情运一般，保持平常心"]
CAREER_ADVICE = ["工作运势不错，努力会有回报", "适合开展新项目，把握机会", "同事关系和谐，团队合作顺利", "今日不宜做重大决定，稳中求进"]
WEALTH_ADVICE = ["财运亨通，投资理财有收获", "正财运佳，工作收入稳定", "偏财运一般，不宜投机", "花费较多，注意节制开支"]
HEALTH_ADVICE = ["身体状况良好，精力充沛", "注意休息，避免过度劳累", "饮食要节制，多吃蔬菜水果", "适量运动，保持身体活力"]

# fixed values: six-line suggestions and defaults
MOVING_SUGGESTIONS = ["无动爻，事态稳定，维持现状即可", "一爻独动，变化明确，可以采取行动", "多爻齐动，情况复杂，需要谨慎考虑"]
STRENGTH_SUGGESTIONS = {"旺相": "用神旺相，所求之事有利", "休囚": "用神休囚，需要等待时机或寻求帮助"}
COMMON_SUGGESTIONS = ["保持积极心态，顺应自然规律", "多做善事，广结善缘"]

# fixed values: purple star
HOUSES = ["命宫", "兄弟", "夫妻", "子女", "财帛", "疾厄", "迁移", "交友", "官禄", "田宅", "福德", "父母"]
BUREAUS = ["水二局", "木三局", "金四局", "土五局", "火六局"]
LIFE_MASTERS = ["贪狼", "巨门", "禄存", "文曲", "廉贞", "武曲", "破军", "武曲", "廉贞", "文曲", "禄存", "巨门"]
BODY_MASTERS = ["火星", "天相", "天梁", "天同", "文昌", "天机", "火星", "天相", "天梁", "天同", "文昌", "天机"]
PURPLE_GROUP = {"紫微": 0, "天机": -1, "太阳": -3, "武曲": -4, "天同": -5, "廉贞": -8}
TREASURY_GROUP = {"天府": 0, "太阴": 1, "贪狼": 2, "巨门": 3, "天相": 4, "天梁": 5, "七杀": 6, "破军": 10}
NOBLE_PLACES = [(2, 8), (9, 7), (12, 10), (12, 10), (2, 8), (9, 7), (2, 8), (3, 5), (4, 1), (4, 1)]
CHANGES = ["化禄", "化权", "化科", "化忌"]
CHANGED_STARS = ["廉贞 破军 武曲 太阳", "天机 天梁 紫微 太阴", "天同 天机 文昌 廉贞", "太阴 天同 天机 巨门", "贪狼 太阴 右弼 天机", "武曲 贪狼 天梁 文曲", "太阳 武曲 天同 天相", "巨门 太阳 文曲 文昌", "天梁 紫微 左辅 武曲", "破军 巨门 太阴 贪狼"]

MAIN_STAR_TEXTS = {  # what it stands for, traits
    "紫微": ("紫微为帝星，主贵气、威严", "领导能力强、有威严、重面子、善管理"), "天机": ("天机为智慧之星，主聪明、机巧", "聪明机智、善谋略、多变化、重分析"), "太阳": ("太阳为光明之星，主热情、博爱", "热情开朗、博爱无私、光明磊落、有责任心"),
    "武曲": ("武曲为财帛之主，主刚毅、果断", "刚毅果断、重视金钱、执行力强、讲求实际"), "天同": ("天同为福德之星，主温和、享受", "性格温和、知足常乐、重享受、人缘好"), "廉贞": ("廉贞为次桃花，主清高、孤傲", "个性独特、追求完美、感情丰富、艺术天分"),
    "天府": ("天府为财库之星，主稳重、保守", "稳重踏实、善理财、保守谨慎、重传统"), "太阴": ("太阴为母性之星，主温柔、细腻", "温柔细腻、富同情心、想象力丰富、重感情"), "贪狼": ("贪狼为第一桃花，主欲望、才艺", "多才多艺、欲望强烈、善交际、求新求变"),
    "巨门": ("巨门为是非之星，主口才、争执", "口才极佳、善辩论、疑心重、追根究底"), "天相": ("天相为宰相之星，主服务、辅佐", "乐于助人、重礼仪、善调和、有正义感"), "天梁": ("天梁为荫庇之星，主清高、孤独", "清高孤傲、有长者风范、喜欢照顾人、宗教缘深"),
    "七杀": ("七杀为将军之星，主威猛、冲动", "个性刚烈、勇猛果敢、独立性强、有冲劲"), "破军": ("破军为破坏之星，主变动、开创", "破旧立新、冒险精神、变化多端、开创力强"),
}
LIFE_TEXTS = [(("文昌", "文曲"), "文星入命，聪明好学，有文艺才华。"), (("左辅", "右弼"), "辅弼相助，贵人运强，容易得到帮助。"), (("化禄",), "化禄入命，财运亨通，为人慷慨。")]
OFFICE_TEXTS = {"": "官禄宫主事业运势。", "none": "官禄宫无主星，事业运势较为平淡，需要靠自己努力打拼。", "紫微": "紫微入官禄，适合管理、领导工作，有权威性。", "天机": "天机入官禄，适合策划、设计、研究类工作。", "太阳": "太阳入官禄，适合公职、教育、公益事业。", "武曲": "武曲入官禄，适合金融、财务、军警类工作。", "天府": "天府入官禄，事业稳定，适合大企业或政府机关。", "化权": "化权入官禄，事业上容易掌权，有领导地位。"}
MONEY_TEXTS = {"": "财帛宫主财运状况。", "武曲": "武曲入财帛，财运佳，善于理财，容易累积财富。", "太阴": "太阴入财帛，财运稳定，适合稳健投资。", "天府": "天府入财帛，财库丰盈，有存钱的能力。", "化禄": "化禄入财帛，财源广进，赚钱机会多。", "化忌": "化忌入财帛，理财需谨慎，避免投机。"}
SPOUSE_TEXTS = {"": "夫妻宫主感情婚姻。", "天同": "天同入夫妻宫，感情和谐，配偶温柔体贴。", "男": "太阴入夫妻宫，妻子温柔贤淑，善解人意。", "女": "太阴入夫妻宫，丈夫体贴细心，重视家庭。", "贪狼": "贪狼入夫妻宫，感情丰富多彩，但需注意桃花。", "化科": "化科入夫妻宫，配偶有才华，感情文雅。"}
ILLNESS_TEXTS = {"": "疾厄宫主健康状况。", "none": "疾厄宫无主星，身体健康状况一般，需注意保养。", "天同": "天同入疾厄，身体较好，但要注意脾胃。", "太阳": "太阳入疾厄，注意心脏、眼睛、血压问题。", "化忌": "化忌入疾厄，健康需特别留意，定期体检。"}
LIFE_TIERS = ["普通格局：需要更多努力，把握机会。", "中等格局：命格平稳，需要努力奋斗。", "中上格局：命格不错，努力可获成功。", "上等格局：命格优秀，一生顺遂，容易成功。"]
ADVANTAGES = [(("文昌", "文曲"), "学习能力强"), (("左辅", "右弼"), "贵人运佳"), (("天魁", "天钺"), "考试运好")]
CHALLENGES = ["某些方面不太顺利，需要努力克服", "命宫无主星，需要更加努力"]
LIFE_SUGGESTIONS = {"紫微": "发挥领导才能，但要注意不要过于自负", "天机": "善用智慧和分析能力，但要避免思虑过度", "太阳": "保持热情和正能量，多做公益事业"}
OFFICE_SUGGESTIONS = ["事业运不错，把握机会，稳步发展", "事业需要自己打拼，保持耐心和毅力"]
CLOSING_SUGGESTIONS = ["培养良好的人际关系，广结善缘", "保持积极乐观的心态，相信自己", "注重身体健康，劳逸结合"]

# fixed values: dream dictionary (keyword, type, good omen, other words)
DREAMS = [
    ("父母", "人物", True, "爸爸 妈妈 长辈 家人"), ("朋友", "人物", True, "同事 同学 邻居 朋友圈"), ("陌生人", "人物", True, "路人 不认识的人 新朋友"), ("死人", "人物", True, "逝者 亡人 鬼魂 先人"),
    ("龙", "动物", True, "神龙 金龙 飞龙在天"), ("凤凰", "动物", True, "凤鸟 朱雀 神鸟"), ("狗", "动物", True, "小狗 大狗 宠物狗 看门狗"), ("猫", "动物", False, "小猫 黑猫 白猫 宠物猫"),
    ("蛇", "动物", False, "毒蛇 大蛇 小蛇 蟒蛇"), ("老虎", "动物", True, "猛虎 白虎 虎王"), ("鱼", "动物", True, "大鱼 金鱼 鲤鱼 活鱼"), ("太阳", "自然", True, "日出 阳光 烈日 朝阳"),
    ("月亮", "自然", True, "满月 新月 月圆 月缺"), ("星星", "自然", True, "繁星 流星 北斗 星空"), ("山", "自然", True, "高山 大山 山峰 登山"), ("海", "自然", True, "大海 海浪 海洋 波涛"),
    ("房子", "建筑", True, "家 房屋 住宅 别墅"), ("学校", "建筑", True, "教室 校园 大学 学堂"), ("医院", "建筑", False, "诊所 病房 手术室"), ("桥", "建筑", True, "大桥 小桥 石桥 木桥"),
    ("水", "水", True, "清水 流水 洪水 井水"), ("河流", "水", True, "大河 小溪 江河 河水"), ("游泳", "行为", True, "潜水 戏水 水中"), ("火", "火", True, "大火 烈火 火焰 篝火"),
    ("蜡烛", "火", True, "烛光 蜡炬 火烛"), ("钱", "金钱", True, "金钱 现金 钞票 硬币"), ("黄金", "金钱", True, "金子 金条 金饰 金币"), ("珍珠", "金钱", True, "珠宝 宝石 钻石"),
    ("米饭", "食物", True, "大米 白饭 粮食"), ("水果", "食物", True, "苹果 橘子 香蕉 葡萄"), ("头发", "身体", True, "长发 短发 掉发 剪发"), ("眼睛", "身体", True, "眼球 视力 眼神"),
    ("红色", "颜色", True, "红色的 鲜红 朱红"), ("金色", "颜色", True, "金黄 金色的 黄金色"), ("白色", "颜色", True, "纯白 白色的 雪白"), ("黑色", "颜色", False, "黑色的 漆黑 深黑"),
    ("三", "数字", True, "3 三个 第三"), ("八", "数字", True, "8 八个 第八"), ("九", "数字", True, "9 九个 第九"),
]
DREAM_TYPE_TEXTS = {"人物": "梦中的人物关系反映了您的社交需求和人际互动", "动物": "动物象征着您内在的本能和直觉力量", "自然": "自然元素代表着生命的循环和内心的和谐", "建筑": "建筑物象征着您的内心结构和安全感", "水": "水元素反映了情感的流动和财富的机遇", "火": "火象征着激情和转化的力量", "金钱": "财富相关的梦境通常预示着经济状况的变化", "食物": "食物代表着基本需求的满足和生活的滋养", "颜色": "颜色传达着情感和能量的信息", "身体": "身体部位反映了健康状况和自我认知", "行为": "行为动作显示了您的主动性和行动力"}
#: What to do, by entry in the order of DREAMS.
DREAM_SUGGESTIONS = [
    "多关心家人健康，孝敬长辈", "珍惜友情，广结善缘", "保持开放心态，迎接新挑战", "放下过去，迎接新生", "把握机会，勇攀高峰", "把握转机，迎接新生",
    "珍惜忠诚的朋友，互相扶持", "相信直觉，但也要理性判断", "保持警觉，化危为机", "展现勇气，但要控制脾气", "把握财运，但要量入为出", "保持积极心态，迎接光明",
    "相信直觉，温柔处事", "坚持梦想，追随内心", "脚踏实地，坚持不懈", "拓宽视野，挖掘潜力", "重视家庭，营造温馨环境", "保持学习心态，不断进步",
    "关注健康，及时体检", "把握转机，主动沟通", "顺势而为，如水般灵活", "顺应自然规律，把握当下", "相信自己的能力，勇敢前行", "保持热情，但要控制火候",
    "保持希望，照亮他人", "把握财机，理性理财", "珍惜机会，创造价值", "注重精神财富，内外兼修", "珍惜现有，知足常乐", "享受生活的甜美，保持健康",
    "保持自信，展现魅力", "相信直觉，明辨是非", "保持热情，迎接喜事", "把握机会，追求卓越", "保持纯真，迎接新生", "面对未知，保持冷静",
    "发挥创造力，稳步发展", "把握机会，追求成功", "追求长远，圆满人生",
]
DREAM_TIER_SUGGESTIONS = [("谨慎行事，多听取他人意见", "反思自己，寻找改善的机会"), ("保持平和心态，稳步前进", "注重内心修养，提升自己"), ("把握当下的好运势，积极行动", "保持乐观心态，相信自己的能力")]
DREAM_GENERIC_SUGGESTION = "多关注内心声音，倾听直觉；保持开放心态，接纳变化；注重身心健康，保持平衡。"
DREAM_COLOURS = {"good": ["红色", "金色", "绿色"], "bad": ["蓝色", "紫色", "白色"], "common": ["黄色", "橙色", "粉色"], "generic": ["蓝色", "绿色", "白色"]}
DREAM_NUMBERS = [3, 6, 8]
DREAM_GENERIC_NUMBERS = [7, 14, 21, 28]
DREAM_OTHER_TEXT = "这些象征包含着深层的心理意义"
DREAM_GENERIC_TEXTS = ["您的梦境反映了内心深层的思考和感受", "这个梦境可能与您当前的生活状况有关", "潜意识通过梦境向您传达重要信息", "梦境显示了您对未来的期望和担忧", "这是内心世界的一种表达和释放"]
DREAM_SUMMARIES = ["这个梦境提醒您需要留意一些潜在的问题或挑战。", "您的梦境包含着复杂的信息，既有机遇也有挑战。", "整体而言，这个梦境带有积极的寓意，暗示着正面的发展。", "总体来说，这是一个非常吉祥的梦境，预示着好运即将来临。"]
DREAM_TIMES = ["需要耐心等待（1年以上）", "较长期（6个月-1年）", "中期（3-6个月内）", "近期（1-3个月内）"]

# fixed values: books (id, title, author, category, core, keywords) and the kinds of daily signs 1 to 20
BOOKS = [
    ("liuyao_001", "增删卜易", "野鹤老人", "liuyao", True, "六爻 卜易 用神 六亲"), ("liuyao_002", "卜筮正宗", "王洪绪", "liuyao", True, "六爻 卜筮 装卦 六神"), ("liuyao_003", "火珠林", "麻衣道者", "liuyao", True, "火珠林 六爻 占法"), ("liuyao_004", "易冒", "程良玉", "liuyao", True, "易冒 易理 六爻"),
    ("meihua_001", "梅花易数", "邵雍", "meihua", True, "梅花易数 邵雍 体用 外应"), ("meihua_002", "康节心易观梅数", "邵雍", "meihua", True, "康节 心易 观梅"), ("bazi_001", "千里命稿", "韦千里", "bazi", True, "八字 命理 格局 用神"), ("bazi_002", "李虚中命书", "李虚中", "bazi", True, "李虚中 命书 四柱"),
    ("bazi_003", "五行精纪", "廖中", "bazi", True, "五行 生克 制化"), ("ziwei_001", "紫微斗数全书", "陈希夷", "ziwei", True, "紫微斗数 陈希夷 星曜"), ("ziwei_002", "斗数宣微", "李振军", "ziwei", False, "斗数 宣微 现代"), ("liuren_001", "大六壬大全", "郭载騋", "liuren", True, "大六壬 三传 四课"),
    ("liuren_002", "毕法赋", "凌福之", "liuren", True, "毕法赋 口诀 占断"), ("liuren_003", "六壬金针", "不详", "liuren", False, "六壬 金针 要诀"), ("qimen_001", "奇门遁甲培训班教材", "幺学声", "qimen", False, "奇门遁甲 培训 教材"), ("qimen_002", "奇门枢要", "不详", "qimen", True, "奇门 枢要 精要"),
    ("fengshui_001", "杨公风水", "杨筠松", "fengshui", True, "杨公 风水 堪舆"), ("other_001", "太玄经", "扬雄", "other", False, "太玄 扬雄 哲学"), ("other_002", "河洛理数", "陈抟", "other", False, "河洛 理数 陈抟"),
]
SIGN_TYPES = ["上签", "中签", "上上签", "上签", "中签", "中上签", "上上签", "中签", "中下签", "中签", "中上签", "上签", "中签", "中上签", "上上签", "中下签", "上签", "中签", "上签", "上签"]

# fixed values: dynasty, file and description of each book, in the order of BOOKS
BOOK_NOTES = [
    ("清代", "六爻古籍合集.pdf", "六爻占卜的集大成之作，详细阐述了六爻断卦的基本理论、用神取法、六亲关系、动静生克、应期判断等内容。"), ("明代", "六爻古籍合集.pdf", "六爻占卜的经典教材，系统介绍了六爻起卦方法、装卦步骤、六神配置、断卦要诀。"),
    ("宋代", "火珠林[宋·麻衣道者着·夜雪校].pdf", "六爻占法的开山之作，创立了火珠林占法体系，对后世影响深远。"), ("清代", "易冒.pdf", "深入解析易理和六爻变化原理，理论与实践并重。"),
    ("宋代", "梅花周易数全集.pdf", "梅花易数的创始之作，详述起卦方法、体用生克、外应取象等核心理论。"), ("宋代", "康节心易观梅数·乾册.pdf", "邵康节先生的心易之法，观梅占断的精髓。"),
    ("民国", "千里命稿.pdf", "现代八字命理的经典之作，系统阐述八字基础理论、格局分析、用神取法。"), ("唐代", "李虚中命书_鬼谷遗文_低调的符号艺术家排版.pdf", "八字命理的源头之作，奠定了四柱预测的理论基础。"),
    ("宋代", "《五行精纪 命理通考五行渊微》（宋）廖中.pdf", "五行学说的集大成之作，详细论述五行生克制化的原理。"), ("宋代", "《紫微斗数全书·完整版》简体中文整理版.pdf", "紫微斗数的权威经典，完整介绍了紫微斗数的理论体系和实践方法。"),
    ("现代", "《斗数宣微1-2》《斗数观测录》李振军整理-微信公众号：灵心紫微斗数.pdf", "现代紫微斗数研究的重要著作，深入浅出地解析斗数理论。"), ("明代", "大六壬大全精校本(简体本).pdf", "大六壬的集大成之作，包含了大六壬的完整理论体系和占断方法。"),
    ("宋代", "《毕法赋全解》北海闲人.pdf", "大六壬占断的重要口诀，总结了七十二种占断法则。"), ("清代", "六壬金针.pdf", "六壬占断的精要总结，如金针度人般点出要害。"),
    ("现代", "不吹牛-奇门遁甲培训班绝密高级内部教材690页-幺学声.pdf", "现代奇门遁甲的系统教材，从基础到高级完整讲解。"), ("清代", "奇门枢要（上册）98页.pdf", "奇门遁甲的精要总结，提纲挈领地阐述奇门要点。"),
    ("唐代", "杨公风水～简福安记-民钞本.pdf", "风水学的经典著作，杨公风水的传承记录。"), ("汉代", "太玄经.pdf", "汉代扬雄仿《周易》而作的哲学著作，自成体系。"),
    ("宋代", "河洛理数-九四版【知识自由社】.pdf", "基于河图洛书的数理预测体系，独树一帜。"),
]

# fixed values: classes of the purple star's lesser stars
LUCKY_STARS = ["文昌", "文曲", "左辅", "右弼", "天魁", "天钺"]
HARMFUL_STARS = ["火星", "铃星", "擎羊", "陀罗", "地空", "地劫"]
