"""Fixed values of the Russian domain: words and patterns that results depend on. Every operator takes them as parameters."""

# Words that carry no meaning for retrieval.
STOP_WORDS = "и в во на по с со для о об а к ко из от до при за или также том числе т ч".split()

# Endings cut off for retrieval, the longest that leaves a stem of four letters.
ENDINGS = (
    "ками ках кам кой ки ка ку ке ок "
    "иями ями ами ого его ому ему ыми ими ией иям иях ую юю ая яя ое ее ые ие ый ий "
    "ой ей ом ем ам ям ах ях ов ев ых их ым им ию ия ии ью "
    "ует уют ают яют ает яет ить ать ять еть ет ют ут ит ат ят ть "
    "а я о е ы и у ю ь й"
).split()

# Markers of modality.
PROHIBITION = ["не вправе", "не имеет права", "не имеют права", "запрещается", "не допускается"]
RIGHT = ["имеет право", "имеют право", "вправе"]
DUTY = [
    "осуществляет", "осуществляют", "обеспечивает", "обеспечивают", "проводит", "проводят", "формирует", "формируют", "представляет",
    "представляют", "организует", "организуют", "обязан", "обязана", "обязаны", "несет ответственность", "несут ответственность",
]

# Turns of phrase that say nothing of the subject; the first four patterns for retrieval, the phrases for duplicates.
TEMPLATE_PATTERNS = [
    r"ин(?:ые|ых|ыми|ую|ой)\s+(?:функци|обязанност|задач|полномочи)[\p{L}\p{N}_]*",
    r"(?:прочи[\p{L}\p{N}_]+\s+)?поручени[\p{L}\p{N}_]*\s+(?:руководств[\p{L}\p{N}_]*|руководител[\p{L}\p{N}_]*|главного\s+аудитора|президента|председател[\p{L}\p{N}_]*)",
    r"(?:согласно|в\s+соответствии\s+с)\s+(?:действующ[\p{L}\p{N}_]+\s+)?законодательств[\p{L}\p{N}_]*",
    r"в\s+пределах\s+(?:своей\s+)?компетенци[\p{L}\p{N}_]*",
]
GENERIC_WORDS = "осуществляет осуществлять осуществление выполняет выполнять выполнение исполняет исполнение прочие прочих иные иных другие других функции обязанности задачи".split()
TEMPLATE_PHRASES = [
    "иные функции", "другие функции", "прочие функции", "иные обязанности", "другие обязанности", "иные полномочия", "другие полномочия",
    "иные задачи", "прочих поручений", "прочие поручения", "иных поручений", "иные поручения", "поручения руководства", "поручений руководства",
    "поручению руководства", "согласно законодательству", "в соответствии с законодательством", "в пределах компетенции", "в пределах своей компетенции", "в рамках компетенции",
]

# Classes of leading verbs, the first that fits.
AUXILIARY = r"^(?:обеспеч[\p{L}\p{N}_]*|осуществл[\p{L}\p{N}_]*|организ[\p{L}\p{N}_]*|координир[\p{L}\p{N}_]*|проводит[\p{L}\p{N}_]*|проведени[\p{L}\p{N}_]*|принима[\p{L}\p{N}_]*\s+участие\s+в|участвова[\p{L}\p{N}_]*\s+в|участ[\p{L}\p{N}_]*\s+в|реализ[\p{L}\p{N}_]*)\s+"
VERB_CLASSES = [
    ("МЕТОДОЛОГИЯ", "нормир|экспертиз"),
    ("СОЗДАВАТЬ", "разработ|разрабат|создани|созда[её]|проектир|формировани|формиру|составлени|составл|подготовк|подготов|внедрени|внедр|запуск|инициир|нормировани|нормир|экспертиз|моделир|автоматизац"),
    ("КОНТРОЛИРОВАТЬ", "контрол|монитор|проверк|проверя|надзор|аудит"),
    ("ВЕСТИ_УЧЁТ", "уч[её]т|учит|вед|регистрац|регистр|актуализ|обновлен|инвентар|архивир|начисл|расч[её]т"),
    ("СОГЛАСОВЫВАТЬ", "согласов|визир|утвержд|рассмотр|подпис"),
    ("ОТЧИТЫВАТЬСЯ", r"отч[её]т|отчит|информир|предоставлени[\p{L}\p{N}_]*\s+отч"),
    ("ЗАКУПАТЬ", "закуп|приобрет|тендер|конкурсн"),
    ("ОБУЧАТЬ", "обуч|консультир|консультац|инструктаж|тренинг|семинар"),
    ("ОРГАНИЗОВЫВАТЬ", "организ|координир|проводит|проведени|обеспеч"),
    ("ЭКСПЛУАТИРОВАТЬ", r"обслуж|эксплуатац|ремонт|техническ[\p{L}\p{N}_]*\s+обслуж"),
]
OTHER_CLASS = "ПРОЧЕЕ"
OBJECT_STOP = "в во и или на по с со для из от до при об о а также том числе университета университете департамента отдела подразделения структурных соответствии рамках целях пределах".split()
OBJECT_STOP_STEMS = "настоящ своевременн качественн надлежащ".split()

# Kinds of units and their case endings.
UNIT_KINDS = {
    "департамент": ("департамент", ["", "а", "у", "ом", "е", "ы", "ов", "ам", "ами", "ах"]),
    "отдел": ("отдел", ["", "а", "у", "ом", "е", "ы", "ов", "ам", "ами", "ах"]),
    "управлени": ("управление", ["е", "я", "ю", "ем", "и", "й", "ям", "ями", "ях"]),
    "служб": ("служба", ["а", "ы", "е", "у", "ой", "", "ам", "ами", "ах"]),
    "блок": ("блок", ["", "а", "у", "ом", "е", "и", "ов", "ам", "ами", "ах"]),
    "сектор": ("сектор", ["", "а", "у", "ом", "е", "ы", "ов", "ам", "ами", "ах"]),
    "групп": ("группа", ["а", "ы", "е", "у", "ой", "", "ам", "ами", "ах"]),
    "центр": ("центр", ["", "а", "у", "ом", "е", "ы", "ов", "ам", "ами", "ах"]),
}
# A clause number's Latin letters that stand for Russian ones.
NUMBER_LATIN, NUMBER_CYRILLIC = "abcehkmoptxy", "авсенкмортху"

# How a performer begins (any case), abbreviations aside; where its phrase ends.
PERFORMERS = (
    "главн\\w*\\s+аудитор\\w* директор\\w* руководител\\w* начальник\\w* заместител\\w* менеджер\\w* аудитор\\w* куратор\\w* работник\\w* сотрудник\\w* специалист\\w* "
    "департамент\\w* отдел\\w* управлени\\w* служб\\w* блок\\w* сектор\\w* групп\\w* центр\\w* обществ\\w* президент\\w* правлени\\w* совет\\w*\\s+директоров комитет\\w*"
).split(" ")
PERFORMER_ENDS = ["не\\s+вправе", "не\\s+имеют?\\s+права", "имеют?\\s+право", "вправе", "обязан\\w*", "долж[енны]+", "осуществля\\w*", "обеспечива\\w*", "нес[её]т", "несут", "отвечает", "отвечают", "[а-яё]+(?:ет|ют|ит|ят|ется|ются|ится|ятся)"]

# Beginnings of auxiliary verbs and of acts, by what an act is.
AUXILIARY_STEMS = "обеспеч осуществл организ координир провод проведен реализ выполн".split()
ACT_CLASSES = {
    "strong": "утвержд утверд подпис контрол проверя проверк провер(?:ит|ить|ять) аудир".split(),
    "weak": "согласов визир".split(),
    "initiate": "иницииру инициир вносит вносят вносить внесени предлага".split(),
    "execute": (
        "разраб созда формир составл подготов готов оформл внедр вед[еу]т вест веден учит учет регистр актуализ начисл расч исполн эксплуат обслуж заполн выда изда закуп "
        "приобрет заключ оплач оплат выплач выплат перечисл инвентар архивир консолид сопровожд обраб принима принят"
    ).split(),
    "refer": "руководств соблюд примен использ ссыла следу изуча знаком".split(),
    "other": "анализ представл направл запрашива взаимодейств информир консульт обуча монитор рассматр оцен выявл определ планир участ содейств".split(),
}
APPROVE_STEMS = "утвержд утверд".split()
ADJECTIVE_ENDS = "ый ий ой ая яя ое ее ые ие ых их ым им ыми ими ую юю ого его ому ему ом ем".split()
VERBAL_NOUN_ENDS = "ние тие нием тием".split()
PAPERS = "акт план программ отчет график заключени протокол результат материал журнал реестр".split()
PREPOSITIONS = "по при в во для без после до с со о об на за под через от из к".split()
REFERENCE_TAILS = ["в соответствии с", "согласно", "на основании", "руководствуясь", "в порядке"]

# Words that end a unit's name, and posts.
UNIT_NAME_ENDS = (
    "в во по с со на для от к ко о об при за из до а также или либо не как что который которая которые которого общества обществе обществом компании подчиняются подчиняется обязан обязаны "
    "имеет имеют вправе осуществляет осуществляют является являются состоит входит входящие несет несут это"
).split()
UNIT_NAME_POSTS = "главный\\s+аудитор главные\\s+аудитор директор руководитель руководители менеджер аудитор заместитель заместители начальник президент специалист куратор работник сотрудник".split()

# Words that say nothing of what a function acts on.
RULE_STOP_WORDS = (
    "в во и или либо на по с со для из от до при об о а также том числе т ч к ко за под над через между без после до его ее их её всех всего всей всем своей своих свой своего "
    "общества общество обществе обществом компании имени рамках целях пределах соответствии соответствующих настоящим настоящего положением положения "
    "установленном установленные установленных предусмотренном предусмотренных необходимых необходимые необходимой иных иные других другие прочих прочие "
    "своевременно своевременную полноту надлежащее ответственности зоне"
).split()
