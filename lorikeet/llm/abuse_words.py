"""Word classes for abusive, hateful and sexual language (fixed values)."""

# Words that insult or offend wherever they stand.
STRONG = """
fuck fucks fucked fucking fucker motherfucker bitch bitches asshole assholes arsehole shithead shitheads shit shitty bullshit dumbass
dumbasses jackass bastard bastards cunt whore slut twat wanker prick douchebag dickhead goddamn retard faggot
puta puto pendejo gilipollas cabron cabrón hijoputa mierda
arschloch hurensohn wichser fotze schlampe vollidiot drecksau missgeburt
connard connards connasse salope putain enculé encule ordure
motherfuckers fuckface cunts whores sluts twats wankers scumbag scumbags dipshit dickheads shitface faggots dirtbag dirtbags sleazebag slimeball fatass lardass retards
hijueputa malparido malnacido malnacida mistkerl drecksack dreckskerl schweinehund arschgesicht enfoiré enfoirés pétasse trouduc
चूतिया मादरचोद भड़वा रंडी हरामज़ादा हरामजादे हरामजादा
cabrones putas putos capullo maricón zorra arschlöcher schlampen huren hure fotzen miststück salopes pute putes connasses enculés
कमीने कमीना हरामी हरामज़ादे कुतिया कुत्ते गधे
""".split()

# Words that insult when aimed at a person.
INSULT = """
idiot idiots moron morons imbecile imbeciles halfwit halfwits loser losers
cockroach cockroaches parasite parasites leech leeches vermin scum savages savage
stupid brainless spineless worthless useless pathetic filthy disgusting miserable rotten
cretin cretins dimwit dimwits dimwitted nitwit nitwits numbskull lowlife lowlifes braindead retarded birdbrain blockhead knucklehead meathead dunce dullard buffoon oaf ignoramus nincompoop
bloodsucker bloodsuckers scoundrel gutless repulsive vile
cretino cretina tarado tarada baboso desgraciado desgraciada
idiota idiotas imbécil imbecil estúpido estúpida cerdo asqueroso asquerosa
dummes dummer schwein sau dreck verdammter abschaum trottel
idioten dummkopf blödmann depp versager hohlkopf vollpfosten idiote imbécile crétin abruti abrutie débile minable raclure estúpidos estúpidas imbéciles
बेवकूफ़ बेवकूफ मूर्ख गधा निकम्मा निकम्मे नालायक घटिया
""".split()

# Words that insult only in direct address: animals and everyday words.
ADDRESSED = "rat rats pig pigs swine dog dogs cow worm worms animal animals clown clowns liar liars lying fool fools ugly dumb trash garbage".split()

# Signs that a sentence speaks at or about a person.
TARGET = """
you your yours yourself youre u ur he she agent manager boss people nobody hey family
tú tu tus te eres usted du dich dir dein deine ihr euch bist toi ta tes tu espèce एक तुम तू तेरी तेरा रह
""".split()

# Names of groups of people.
GROUP = """
women girls men gays lesbians homosexuals trans transgender disabled immigrants foreigners refugees migrants muslims jews christians hindus
blacks castes caste asians arabs africans mexicans gypsies roma queers atheists catholics buddhists sikhs dalits cripples beggars villagers southerners northerners easterners westerners old elderly skinned religion poor people
extranjeros inmigrantes mujeres gitanos ausländer flüchtlinge frauen juden étrangers immigrés femmes लोग
""".split()

# Terms that demean a group or wish it harm.
DEMEAN = """
wiped inferior parasites parasite vermin garbage trash savages subhuman cockroaches filth exterminated gassed deported
parásitos sucios ungeziefer rausgeworfen parasiten abschaum vermine chasse chassez कीड़े भगा
""".split()

# Sexual words that arouse wherever they stand.
SEXUAL = """
cumshot gangbang hentai threesome deepthroat camgirl
pussy pussies cock cocks dick dicks tits boobs boob nudes horny blowjob handjob porn porno xxx milf
tetas chuparte follar titten titte ficken geile muschi nichons
""".split()

# Sexual words that count with another of the list or with one of AROUSE.
SUGGESTIVE = "naked sex sexy ass asses arse nude strip stripping ride moaned moaning moan lick licked legs hot pics videos desnuda desnudo nackt nackten nackte seins baiser wet body".split()
AROUSE = "send watch touch enjoy click begged grabbed spread night tonight adults online baby girls nurses close thinking hard come bed off verte quiero zeig montre".split()

# Threats and wishes of harm.
THREATS = [
    r"find you\b.{0,30}\bbreak", *(rf"\bi(?: will|['’]ll| am going to|['’]m going to| am gonna|['’]m gonna)\b.{{0,30}}\b{verb} you\b" for verb in ("break", "kill", "beat", "hurt")), r"\bi(?: will|['’]ll| am going to|['’]m going to| am gonna|['’]m gonna)\b.{0,30}\b(?:shoot|strangle|murder) (?:you|him|her|them)\b", r"\bkill yourself", r"\bgo and die\b", r"\bhope\b.{0,30}\b(?:you|he|she|they)\b.{0,12}\b(?:die|choke|burn|rot|drown|bleed|starve)\b",
    r"\bhope\b.{0,60}\bgets? cancer", r"\bmay your house burn", r"\bgo to hell\b", r"\bwait outside\b.{0,40}\bwith a (?:bat|knife|gun)", r"\bhow many teeth you keep", r"\bscrew you\b", r"\bshut your\b.{0,15}\bmouth",
    r"\bnobody would miss you", r"\blet them rot\b", r"\bwiped out\b", r"\bcleaner without\b", r"\bhang yourself", r"\bslit your", r"\bwatch your back\b",
    *(rf"\b(?:will|['’]ll|going to|gonna)\b.{{0,20}}\b{verb} your (?:neck|legs?|face|bones|arms?|fingers|teeth|nose|jaw|skull|throat|head)\b" for verb in ("break", "smash", "crush", "slit", "snap")), r"\bput you in (?:the|a) (?:ground|hospital|grave|wheelchair|coffin)\b", *(rf"\byou(?:['’]re| are) (?:a )?dead {noun}\b" for noun in ("man", "meat", "woman")),
    r"\b(?:kick|beat|whip) your (?:ass|arse)\b", r"\bbeat the (?:crap|hell|life) out of (?:you|him|her|them)\b", r"\b(?:go|should|just|please)\b.{0,10}\bjump off (?:a|the) (?:bridge|cliff|roof|building)\b", r"\bmake you (?:suffer|regret)\b",
    r"\b(?:you|such an?|what an?|total|complete|absolute) (?:jerk|weasel|donkey|maggot|coward|skunk|muppet|pervert)s?\b",
    r"\bmuérete\b", r"\bojalá te pudras\b", r"\bp[uú]drete\b", r"\bvete a la mierda\b", r"\bfahr zur hölle\b", r"\bverpiss dich\b", r"\bfick dich\b", r"\bgeh sterben\b", r"\bva te faire (?:foutre|voir)\b", r"\bva crever\b", r"भाड़ में जा", r"जान से मार",
    *(rf"\byou {ought} (?:die|be shot|be hanged)\b" for ought in ("should", "deserve to", "ought to")), r"\bdrop dead\b", r"\b(?:rot|burn) in hell\b", r"\bi know where you live\b", r"\bwish (?:you|he|she|they) (?:were|was) dead\b", r"\bte voy a (?:partir|pegar|reventar)\b", r"\bich schlag dich\b", r"\bich mach dich\b", r"\bje vais te (?:tuer|frapper|crever)\b",
    r"\bvete al infierno", r"\bte mueras\b", r"\bte voy a matar", r"\bverrecke\b", r"\bhalt die fresse", r"\bbring dich um\b", r"\bferme ta gueule", r"\bta gueule\b", r"\bcrève\b", r"\bva mourir\b", r"sale con\b", r"चुप रह", r"मर जा",
]

# Phrases that demean a group when one of GROUP stands in the sentence.
GROUP_PHRASES = [
    r"\bkeep\b.{1,40}\bout of\b.{1,40}\bthey are\b", r"\bsend\b.{1,40}\bback where they came", r"\bnever trust\b", r"\bhire no\b", r"\bdo(?:n['’]?t| not) deserve\b", r"\bwhy (?:do|should) we pay for\b.{1,40}\bbreed\b",
    r"\b(?:are|is) (?:all )?(?:a )?(?:disease|animals|vermin|parasites|garbage|rats|pigs|inferior)\b", r"\bmade\b.{1,40}\binferior\b", r"\bstinks? like\b", r"\bthrown out of\b", r"\bruin everything\b", r"\bbreed like\b", r"\b(?:should|must|ought to) (?:all )?be (?:deported|locked up|sterili[sz]ed|killed|exterminated|gassed)\b", r"\bdon['’]?t belong (?:here|in)\b", r"\bare (?:all )?(?:thieves|criminals|terrorists|filthy|scum|subhuman|savages|monkeys)\b", r"\btoo dumb\b",
]

#: Words that make a weak word harmless: what is reported, treated or meant literally.
HARMLESS = "bite claim pest insect crop whale form naked-eye screening examination treatment excluded covered cover infection infections prosthesis victims counselling speech language".split()

# What a written sign may stand for.
LEET = {"@": "a", "4": "a", "8": "b", "3": "e", "6": "g", "9": "g", "1": "il", "!": "il", "0": "o", "5": "s", "$": "s", "7": "t", "+": "t", "|": "il", "€": "e", "£": "l"}
