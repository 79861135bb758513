"""Words of the shelf: kinds, flavours, packs and advertising, as stems.

Fixed values of the domain; all are parameters of :class:`polka.llm.product.Parser`.
"""

# kind: ways to name it; of one way every stem must begin a word (or be one, after =)
KINDS = {
    "сыр плавленый": ["плавл", "сырок"],
    "сыр полутвёрдый": ["полутв", "п/тв"],
    "печенье сдобное": ["печень", "=печ"],
    "яйцо куриное": ["=яйцо", "=яйца", "=яиц"],
    "творог": ["творог", "=творожок", "=твор"],
    "сметана": ["=сметана", "=смет"],
    "пельмени": ["пельмени", "=пельм"],
    "молоко ультрапастеризованное": ["у/паст", "=у/п", "ультрап", "=ульт"],
    "молоко пастеризованное": ["=паст", "пастер"],
    "сервелат варёно-копчёный": ["сервел", "=серв"],
    "колбаса варёная": ["колбас", "=колб"],
    "сок": ["=сок"],
    "тушёнка говяжья": ["тушен", "=туш"],
    "масло подсолнечное": ["подсол", "=подс"],
    "масло сливочное": ["=масло =слив", "=масло сливоч", "=м-ло =слив", "=м-ло сливоч", "=масл =слив", "=масл сливоч"],
    "зефир": ["зефир", "=зеф"],
    "шоколад молочный": ["шоколад молоч", "шоколад =мол", "=шок молоч", "=шок =мол"],
    "мороженое пломбир": ["пломб", "морож"],
    "сахар тростниковый": ["=сахар", "сахар-"],
    "вафли": ["вафл", "=ваф"],
    "йогурт питьевой": ["йогурт", "=йог"],
    "спагетти": ["спагет", "=спаг"],
    "макароны рожки": ["=рожки", "=рожок", "=рож"],
    "чай зелёный в пакетиках": ["=чай зелен", "=чай =зел", "=чай пакет"],
    "чай чёрный листовой": ["=чай черн", "=чай =чер", "=чай лист"],
    "лимонад": ["=лимонад", "=лим-д", "напиток =газ"],
    "ряженка": ["ряжен", "=ряж"],
    "вода питьевая": ["=вода"],
    "кофе молотый": ["=кофе молот", "=кофе =мол", "=коф молот", "=коф =мол"],
    "кофе растворимый": ["=кофе раств", "=коф раств", "=кофе субл", "=коф субл"],
    "рис длиннозёрный": ["=рис", "рисов"],
    "салфетки бумажные": ["салфет", "=салф"],
    "хлопья овсяные": ["хлопья", "=хлоп", "=овсяные", "=овс"],
    "крупа гречневая ядрица": ["гречн", "гречк", "ядриц"],
    "капсулы для стирки": ["капсул", "=капс"],
    "кефир": ["кефир", "=кеф"],
    "горошек зелёный": ["горош", "=горох"],
    "мука пшеничная": ["=мука", "пшенич", "=пш", "=пшен"],
}

# kind: {flavour: stems}; a word that begins with a stem, or is the stem where that begins with =, names the flavour
FLAVOURS = {
    "сыр плавленый": {"ветчина": ["ветч"], "грибы": ["гриб"], "сливочный": ["сливоч", "=слив"]},
    "печенье сдобное": {"крошка": ["крошк", "шокол", "=шок"], "орех": ["орех"], "овсяное": ["овсяно", "=овсян", "=овс"]},
    "яйцо куриное": {"деревенское": ["дерев"], "отборное": ["отборн", "=отб"], "с1": ["=с1", "=1кат"]},
    "пельмени": {"домашние": ["домаш"], "курица": ["куриц", "курин"], "говяжьи": ["говяд", "говяж"]},
    "колбаса варёная": {"молочная": ["молоч", "=мол"], "телятина": ["телят"], "нежная": ["нежн"]},
    "сок": {"яблоко": ["яблок", "яблоч", "=ябл"], "вишня": ["вишн", "=виш"], "апельсин": ["апельс", "=апел"], "томат": ["томат", "=том"]},
    "тушёнка говяжья": {"первый": ["первый", "=перв", "=1с"], "высший": ["высш", "=в/с"]},
    "масло подсолнечное": {"нераф": ["нераф"], "раф": ["рафин", "=раф"]},
    "зефир": {"ваниль": ["ванил"], "клюква": ["клюкв"], "бело-розовый": ["бело-", "бел/", "белороз"]},
    "шоколад молочный": {"фундук": ["фундук", "=фунд"], "карамель": ["карамель", "=карам"], "миндаль": ["минд"], "изюм": ["изюм"]},
    "сыр полутвёрдый": {"копчёный": ["копч"], "сливочный": ["сливоч", "=слив"], "тмин": ["тмин"]},
    "мороженое пломбир": {"крем-брюле": ["крем", "кр.-бр", "брюл"], "ваниль": ["ванил"], "шоколад": ["шокол", "=шок"]},
    "вафли": {"сгущёнка": ["сгущ"], "пралине": ["пралин"], "лимон": ["лимон"]},
    "йогурт питьевой": {"натуральный": ["натур"], "персик": ["персик"], "черника": ["черник"], "клубника": ["клубн"], "вишня": ["вишн"]},
    "чай зелёный в пакетиках": {"жасмин": ["жасм"], "лимон": ["лимон"], "мелисса": ["мелисс"]},
    "чай чёрный листовой": {"бергамот": ["бергам"], "чабрец": ["чабр"], "крупнолистовой": ["крупн"]},
    "лимонад": {"тархун": ["тарх"], "дюшес": ["дюшес", "=дюш"], "цитрус": ["цитрус", "=цитр"]},
    "вода питьевая": {"негаз": ["негаз", "=н/газ"], "газ": ["газир", "=газ"]},
    "салфетки бумажные": {"рисунок": ["рисун"], "белые": ["белые", "=бел"]},
    "хлопья овсяные": {"классические": ["классич", "=класс"], "изюм": ["изюм"], "яблоко": ["яблок", "кориц"]},
    "капсулы для стирки": {"альпийская": ["альп"], "цветное": ["цветн", "д/цвет"]},
    "кофе молотый": {"тёмная": ["темн"], "средняя": ["средн", "=ср"]},
}

# other stems that no brand or product line is made of
OTHER = """
для всей семьи вкус детства топ продаж без гмо лучшая цена от производителя быстрая доставка гарантия свежести
свежий завоз большая упаковка в наличии хит акция скидка подарок премиум оригинал выгодно sale new sale! хит!
обжарки обж начинкой стирки д/стирки средство бумажные бум пакетиках пакет пак картон лоток дойпак контейнер
тетрапак т/пак пюр-пак пл/бут пэт ст/б ж/б м/у в/у п/о н/о ф/о брикет стакан стаканчик ванночка ведерко сектор
нарезка брус фольга плитка коробка вак уп жирн жир мдж бренд марка тм завод россия фас фасов продукт кефирн
питьевая питьевой пит питьев столовая напиток макароны макарон макаронные изд крупа каша консерв восстановл осв
замор п/ф в/к вар варен вареная вареной свеж альпийская варено-копченый копченый сдобное сдобн молочный молочная сливочный сливочное слив масло масл
м-ло молоко м-ко мол зеленый зел черный черн листовой лист лист. длиннозерный длинн длиннозерн тростниковый тростн
трост песок пшеничная пшен ядрица куриное куриные кур яйцо яйца говяжья говяж говядина гов тушеная сорт кат
высший первый класс средней темной темн штук шт упаковка грамм литра литр кило килограмм миллилитров полкило
""".split()
