"""Words and patterns of abusive language by language and role: general vocabulary, written down by hand.  What is peculiar to a
corpus (invented names, favourite sentences) is not here; it is learnt from judged examples.

Patterns: ``;`` parts them, ``(a|b)`` is a choice, ``<name>`` one of ``PARTS``.  Words and texts are folded alike (lower case,
no accents, no apostrophes) before they are compared.
"""

from __future__ import annotations

#: Nouns that insult whomever they are said of.
INSULTS = {
    "en": "idiot imbecile moron halfwit dimwit nitwit cretin dumbass dickhead jackass asshole arsehole shithead scumbag motherfucker fuckwit fucktard fuckface dumbfuck douchebag dipshit wanker tosser twat cunt slut whore cocksucker bullshitter fucker bellend knobhead numbskull numskull blockhead bonehead airhead birdbrain simpleton dunce retard libtard shitbag arsewipe asswipe asshat dullard ignoramus dolt lowlife bootlicker",
    "de": "arschloch wichser hurensohn schlampe fotze missgeburt vollidiot idiot drecksau drecksack miststuck mistkerl spast schwuchtel trottel vollpfosten dummkopf schwachkopf penner volltrottel hackfresse saftsack arschgeige dreckschwein drecksschwein nutte hurenkind depp vollhonk",
    "fr": "connard connasse salope salaud encule abruti batard batarde putain pute imbecile cretin cretine enfoire ordure enflure pouffiasse trouduc bouffon pourriture charogne pedale tapette idiot idiote debile",
    "es": "gilipollas imbecil idiota cabron cabrona pendejo hijoputa puta zorra capullo maricon subnormal mamon cretino payaso mongolo huevon culero pelotudo malnacido sinverguenza estupido estupida",
    "nl": "klootzak trut hoer kutwijf eikel kankerlijer lul sukkel mongool teringlijer tyfuslijer debiel idioot smeerlap rotzak flikker slet klojo hufter mietje kutkop achterlijke",
}
#: Nouns with an innocent sense, which insult where nothing speaks for that sense.
AMBIGUOUS = {"en": "bastard bitch prick git berk plonker slag creep pervert skank tart faggot arse", "de": "bastard", "fr": "chienne conne", "nl": "teef"}
#: Names for groups of people that only degrade.
SLURS = {"en": "nigger nigga kike spic gook wetback raghead towelhead shemale tranny faggots", "de": "untermensch untermenschen judensau kanake kanaken neger kameltreiber", "fr": "bougnoule youpin negre bicot sous-hommes", "es": "sudaca negrata", "nl": "ondermens ondermensen nikker kutmarokkaan kutmarokkanen"}
#: Nouns that insult whom they are said to: ``you pathetic creature``.
WRETCHES = {
    "en": "creature person thing excuse fool clown pig cow rat worm animal loser liar coward freak monkey dog parasite monster brat failure nobody snake weasel toad swine sheep donkey ape baboon disgrace embarrassment pest vermin peasant bum thug crook fraud hypocrite sicko psycho lunatic nutcase weirdo muppet leech scum filth trash garbage turd crap shit slob wimp sissy",
    "de": "schwein hund ratte abschaum affe niete versager null sau vieh tier stuck wicht kerl sack lugner feigling nichts kuh ziege gans hexe esel scheusal widerling wurm",
    "fr": "porc chien chienne merde nul nulle type dechet incapable clown singe ane tache lache menteur menteuse minable rat ver vermine moins-que-rien con conne cochon",
    "es": "mierda basura inutil asco cerdo cerda burro fracasado fracasada rata payaso mono gusano animal cobarde mentiroso mentirosa escoria miserable perro perra bicho nadie",
    "nl": "varken hond koe rat zak muts doos aap ezel worm nul niks mislukkeling leugenaar lafaard monster beest stuk-vreten stuk-ongeluk etter ding",
}
#: Those that insult only behind an adjective of contempt.
PLAIN = frozenset(
    "person creature thing excuse animal joke dog cow monster fool nichts null stuck wicht kerl sack tier vieh hund kuh ziege gans hexe esel wurm type chien porc ane singe rat ver nul nulle tache con mono burro rata animal perro perra gusano nadie bicho hond koe zak muts doos ding niks nul ezel worm beest embarrassment".split()
)
#: What counts as such an adjective there, besides ``CONTEMPT``.
NASTY = frozenset("filthy ugly rotten lying dirty miserable nasty lousy crazy sick greedy lazy fat pauvre sale sales gros vuile vieze puto puta pedazo cochino poor".split())
#: Adjectives of contempt.
CONTEMPT = {
    "en": "stupid dumb dumber dumbest stupider stupidest pathetic worthless spineless brainless disgusting useless idiotic moronic braindead clueless incompetent retarded witless gormless gutless heartless mindless vile despicable repulsive contemptible fucking goddamn shitty",
    "de": "scheiss verdammte verdammter verdammtes dumm dumme dummer dummes dummen blod blode bloder blodes bescheuert bescheuerte bescheuerter damlich damliche damlicher damliches hirnlos hirnlose hirnloser hirnloses wertlos wertlose wertloser wertloses nutzlos nutzlose nutzloser widerlich widerliche widerlicher widerliches mieses mieser miese erbarmlich erbarmliche erbarmlicher unfahig verfickte verfickter verficktes beschissene beschissener dreckiges dreckiger dreckige",
    "fr": "stupide nul nulle debile minable pathetique inutile incapable degoutant degoutante pourri pourrie ridicule lamentable sale ignoble abject abjecte",
    "es": "estupido estupida tonto tonta inutil patetico patetica asqueroso asquerosa miserable ridiculo ridicula maldito maldita jodido jodida penoso penosa despreciable cobarde",
    "nl": "dom domme stom stomme achterlijk waardeloos waardeloze nutteloos nutteloze zielig zielige walgelijk walgelijke hersenloos hersenloze smerig smerige vieze lelijke vuile luie verdomde",
}
#: Nouns for people that make no people of them; those of ``VERMIN`` also name animals, illnesses and waste.
SUBHUMAN = {"en": "subhuman subhumans scum filth savages maggots", "de": "abschaum untermenschen gesindel schmarotzer dreckspack", "fr": "racaille pourriture sous-hommes", "es": "escoria chusma alimanas", "nl": "tuig uitschot schorem"}
VERMIN = {
    "en": "vermin parasites cockroaches rats animals pigs apes monkeys dogs insects lice dirt trash garbage disease plague cancer virus thieves liars criminals rapists terrorists inferior parasite pest",
    "de": "ungeziefer parasiten ratten tiere viecher kakerlaken schweine affen mull dreck krebsgeschwur seuche pest verbrecher diebe vergewaltiger",
    "fr": "vermine parasites rats cafards dechets animaux porcs singes ordures voleurs criminels violeurs cancer peste",
    "es": "basura ratas parasitos cucarachas plaga animales cerdos monos ladrones criminales violadores cancer peste",
    "nl": "ongedierte parasieten ratten kakkerlakken dieren varkens apen dieven criminelen verkrachters kanker pest vuil",
}
#: Groups of people that hatred picks.
GROUPS = {
    "en": "people folk folks lot jews muslims gypsies refugees immigrants migrants foreigners arabs blacks gays lesbians homosexuals christians asians africans poles turks mexicans indians chinese women race tribe breed natives",
    "de": "leute menschen auslander juden turken zigeuner fluchtlinge asylanten moslems muslime schwarze schwule lesben polen araber frauen alle pack",
    "fr": "gens etrangers arabes juifs musulmans migrants refugies noirs roms gitans immigres types femmes",
    "es": "gente inmigrantes moros gitanos judios negros extranjeros refugiados musulmanes mujeres",
    "nl": "mensen buitenlanders joden moslims turken marokkanen vluchtelingen zigeuners lui volk vrouwen",
}
#: Endings of names of peoples, which count as groups behind an article.
PEOPLE_ENDINGS = ("ians", "ans", "ers", "ish", "men", "ese", "ites", "is")
#: Of ``VERMIN``, what things are said to be as well.
THINGS = frozenset("dirt trash garbage disease plague cancer virus inferior pest mull dreck krebsgeschwur seuche dechets ordures peste basura plaga vuil kanker parasite".split())
#: Parts of the body that are named like this only for lust or abuse, and those that are named so among others.
LEWD = {"en": "tits titties boobs boobies pussy cock nipples cleavage panties ass butt bum dick", "de": "titten muschi fotze arsch schwanz mopse brueste bruste po hintern", "fr": "seins nichons cul chatte fesses bite cuisses", "es": "tetas culo cono polla tetitas nalgas pechos", "nl": "tieten kut kont reet borsten billen pik"}
#: Verbs and words of sex that are written for lust or abuse.
SEX_VERBS = {"en": "fuck shag lick undress spank grope ride screw bang fondle caress mount ravish suck", "de": "ficken vogeln bumsen lecken ausziehen blasen befummeln", "fr": "baiser lecher sucer deshabiller niquer sauter enculer peloter", "es": "follar follarte comerte chuparte lamerte desnudarte tirarte cogerte", "nl": "neuken likken pijpen uitkleden beffen betasten"}
EXPLICIT = {"en": "porn porno blowjob blowjobs handjob milf milfs horny cumshot nudes gangbang dildo orgy xxx deepthroat creampie", "de": "geil geile geilen geiler pornos nacktfoto nacktfotos nacktbild nacktbilder wichsen", "fr": "pornos branlette pipe sodomie partouze", "es": "mamada cachonda cachondo pajas porno", "nl": "geil geile pornofilm naaktfoto naaktfotos"}
#: Parts of the body that are named with desire, where words of desire are near.
DESIRED = {"en": "lips skin body mouth legs thighs hips curves breasts neck hair perfume", "de": "lippen haut korper mund beine schenkel huften kurven", "fr": "levres peau corps bouche jambes hanches courbes", "es": "labios piel cuerpo boca piernas caderas curvas", "nl": "lippen huid lichaam mond benen dijen heupen"}
DESIRE = frozenset(
    "kiss kissing lick touch touching taste dream dreaming naked bed night tonight moan sexy wet tongue caress undress horny nackt bett heute nacht traume streicheln kussen lecken nue lit nuit reve caresser embrasser lecher desnuda cama noche sueno acariciar besar lamer naakt nacht droom strelen zoenen likken".split()
)
BARE = {"en": "naked nude topless undressed", "de": "nackt", "fr": "nue nu", "es": "desnuda desnudo", "nl": "naakt bloot"}
#: Verbs of violence with a person as their object; of those of the second list some are also said in kindness.
VIOLENCE = {
    "en": "kill murder strangle stab butcher slaughter rape poison drown behead lynch castrate torture maim cripple thrash disembowel",
    "de": "umbringen toten erschiessen erschlagen erwurgen erstechen abstechen totschlagen verprugeln zerquetschen aufschlitzen kaltmachen fertigmachen erschiesse erschiess erwurge erwurg erschlage erschlag verprugle verprugel ersteche erstech vergewaltigen",
    "fr": "tuer crever buter egorger frapper etrangler defoncer demolir massacrer poignarder tabasser cogner violer saigner bruler exploser",
    "es": "matar matarte degollar estrangular apunalar machacar violar destrozar rajar quemar pegarte reventarte romperte",
    "nl": "vermoorden vermoord doden afmaken neersteken neerschieten wurgen kapotmaken verkrachten doodslaan",
}
VIOLENCE_TOO = {"en": "hurt gut skin shoot cut beat burn hit hang crush bury destroy punch slap choke smash bash whip end finish"}
#: What follows ``you`` where such a verb is said in kindness.
KINDLY = frozenset("a an some slack to at in on by the up off another as it this that there".split())
HARM = {"en": "break smash crush cut rip tear snap slit kick bash knock punch chop saw crack split burn gouge bust cripple wring poke bite"}
BODY = {"en": "fingers finger legs leg arms arm neck face skull head teeth jaw knees knee bones bone throat nose hands hand ribs eyes kneecaps tongue spine balls ears guts house home car"}

#: Words for the person spoken to, words that may stand between them and what they are called, words of the one who threatens.
YOU = {"en": "you youre u ya yourself your ur", "de": "du dich dir dein deine deinen deinem deiner euch euer eure ihr", "fr": "tu te toi t ton ta tes vous votre vos", "es": "tu te ti tus eres usted vosotros sois", "nl": "je jij jou jouw jullie"}
YOURS = {"en": "your ur", "de": "dein deine deinen deinem deiner eure", "fr": "ton ta tes vos votre", "es": "tu tus", "nl": "je jouw jullie"}
BETWEEN = {
    "en": "a an the are re is such so too very really just only nothing but as even most more bloody damn damned little old big great complete total absolute utter real right one of all my plain simply being truly quite always still fat dirty miserable poor sorry lying rotten filthy ugly lazy greedy crazy sick were must be ve got lousy nasty bunch pack load filthy own sweet nice tight hot wet sexy perfect lovely beautiful gorgeous juicy every single and you",
    "de": "bist seid ein eine einen so zu sehr echt wirklich einfach nur als der die das verdammter verdammte verdammtes alter alte kleiner kleine doch ja vollig total wie und bloss ganz geilen geile sussen dicken grosse grossen schonen ihr",
    "fr": "es etes un une si trop vraiment tellement qu que vrai gros grosse petit petite pauvre espece de d bien juste des les la l du bande vieux vieille gros beaux jolis joli belle etes est",
    "es": "eres sois un una tan muy realmente solo pedazo de trozo vaya menudo grandisimo todo puro puto puta maldito ricas buenas lindas bonito sos",
    "nl": "bent zijn een zo te echt gewoon wat oude ouwe kleine grote enorme totale vuile vieze lekkere mooie dikke geile stuk en",
}
ARE = {"en": "are re is were being like as be", "de": "sind ist seid bist waren wie", "fr": "sont est etes sommes comme", "es": "son es sois eran como", "nl": "zijn is bent waren als"}
SOMEBODY = {"en": "i ill im id we someone somebody they gonna swear somebodys", "de": "ich wir jemand man werden werde", "fr": "je j on nous quelqu vais va vont veux", "es": "voy vamos quiero van alguien queremos", "nl": "ik we wij iemand ga gaan zal"}
WANT = {"en": "want wanna love like need going gonna ready bet dream dreaming keen", "de": "will mochte wurde", "fr": "veux envie voudrais aimerais vais", "es": "quiero ganas voy gustaria", "nl": "wil zou ga"}
OTHERS = {"en": "her his their my those these big huge nice hot great some", "de": "ihre ihren seine diese geile geilen dicke dicken", "fr": "ses leurs gros beaux ces", "es": "sus las esas esos unas buenas", "nl": "haar zijn die lekkere dikke"}
HAIL = frozenset("hey hi hello ok okay listen oi dear hallo eh oye hoi he ey salut hola dag na".split())
MUST = {"en": "should must ought deserve deserves need needs have belong"}
DRIVEN = {"en": "deported exterminated gassed hanged lynched sterilised sterilized castrated slaughtered eradicated banned stoned whipped shot jailed enslaved expelled drowned wiped burned burnt culled killed"}

#: What shows that someone speaks of his own mistake.
OWN = (
    "i am; i m; im; i was; i feel; i felt; i must be; i have been; i ve been; sorry; ich; ich bin; ich war; bin ich; war ich; je suis; j etais; suis je; j ai ete; soy; fui; he sido; ik; ik ben; ik was; ben ik"
)
OWN_AFTER = "of me; of mine; me; that i am; von mir; wie ich; de ma part; de moi; que je suis; de mi parte; por mi parte; que soy; van mij; die ik ben"
#: What shows that a word is mentioned, forbidden or explained, not said.
MENTION = frozenset(
    "word words term terms policy policies forbids forbid forbidden prohibited slur slurs harassment definition dictionary guideline guidelines moderation blocklist profanity vocabulary wort worter begriff begriffe richtlinie verboten mot mots terme interdit palabra palabras termino prohibido woord woorden term verboden".split()
)
#: Words near an ambiguous one that settle an innocent sense.
SENSES = {
    "bitch": "mated whelped litter puppies pups kennel breeder dog dogs bred whelp oestrus estrus spayed canine", "bastard": "wing file sword toadflax hartebeest title bird cut", "prick": "needle finger skin test tests heel pin pricks lancet allergy glucose",
    "cock": "crow crows crowed hen hens rooster fowl pheasant weather dawn chicken", "ass": "donkey wild horse mule african somali", "arse": "", "pussy": "willow cat", "tits": "blue great coal marsh bird birds nest nests", "dick": "mr dr van call turner", "butt": "joint cigarette water joints", "bum": "bag rap",
    "retard": "growth flame fire development", "retarded": "growth flame fire development fetal intrauterine mental", "cretin": "thyroid iodine", "imbecile": "register census act historical classification", "idiot": "proof savant register census historical guide", "moron": "register census historical classification",
    "rape": "oilseed oil crisis seed canola victims victim survivors law court", "tart": "apple cherry lemon custard treacle", "faggot": "wood bundle sticks", "slag": "heap furnace steel", "creep": "scope feature soil steel", "git": "commit push pull branch repository merge clone", "scum": "pond milk", "dogs": "", "zorra": "bosque animal", "capullo": "flor rosa", "teef": "puppy nest honden", "slet": "", "con": "",
    "schwein": "stall bauer haus", "hund": "leine hutte tierarzt", "ratte": "labor kafig", "porc": "viande elevage", "cerdo": "granja carne", "burro": "granja", "eikel": "boom eik bomen", "pipe": "tabac eau", "bite": "", "ride": "bike bus train", "bang": "theory big", "mount": "disk drive volume point", "suck": "air", "virus": "infection", "subnormal": "number numbers",
}

PARTS = {
    "will": "i will|ill|i ll|i am going to|im going to|i m going to|i shall|i swear i will|i swear ill|i want to|i would love to|we will|we ll|we are going to|gonna|someone should|somebody should|someone will|someone ought to",
    "kin": "children|kids|family|wife|husband|daughter|son|mother|parents|little girl|little boy",
    "pics": "pictures|photos|pics|selfies|picture|photo|pic|images|videos|video",
    "race": "jew|muslim|gypsy|arab|black|indian|turk|pole|immigrant|foreigner",
    "adj": "stupid|dumb|pathetic|worthless|spineless|brainless|disgusting|goddamn|fucking|useless|filthy|ugly|rotten|lying|dirty|shitty|big|fat",
    "limb": "throat|eyes|tongue|head|balls|heart|guts",
}

#: Idioms that are abuse on their own.
PATTERNS: dict[str, dict[str, str]] = {
    "insult": {
        "en": "(what|something|hell) is wrong with you you; how (stupid|dumb|thick|dense) (are|can) you; are you (really that |really so |that |so |)(stupid|dumb|thick|dense|retarded); too (stupid|dumb|thick) to; (a|any) (trained|drunk|blind) (monkey|chimp|ape) (could|would|can); (anyone|anybody|people|somebody|someone) with half a brain; (smarter|brighter|cleverer|more useful) than you; nobody asked you; who asked you; a disgrace to; an embarrassment to (this|the|your|us|our|mankind); your (work|code|mails|mail|brain|scripts|opinion|opinions) (is|are) (garbage|trash|crap|shit|worthless); you (should be ashamed|have no (brain|spine|shame|talent)); go cry to your (mommy|mother|mum); good for nothing; (sad|sorry|poor) excuse for; "
        "your (<adj>) (mouth|face|head|brain|ass|arse|trap|gob); (keep|shut) your (|<adj> )(mouth|trap|gob|face)(| shut| closed); shut the (fuck|hell) up; shut your (face|mouth|trap|gob); (make|makes|made) me want to (throw up|vomit|puke|be sick); you (make me sick|make me puke|disgust me); "
        "(go to|burn in|rot in) hell; (piss|fuck|bugger|sod) off; (fuck|screw|damn) you; drop dead; (go fuck|fuck|go screw|screw) yourself; eat shit; kiss my (ass|arse); (piece|pieces|sack|pile|bag|heap) of (shit|shits|crap|filth|garbage); waste of (oxygen|space|air|skin|breath); get lost you; "
        "crawl back (under|into|to) (your|the|a|that) (stone|rock|hole|cave|sewer); (dumber|stupider|thicker|uglier) than (a|an|you|the|my|any); the size of a (pea|walnut|peanut); (son|sons) of a bitch; (did|does) your (mother|mum|mom) (dress|raise|drop|teach|know); "
        "(everybody|everyone|nobody) (hates|despises|loathes) you; nobody (likes|wants) you; (more|less) (brains|brain|sense|intelligence|spine|talent) than you; brain (dead|damaged); lick my (boots|ass|arse); you are (not worth|an insult to); you are a (disgrace|joke|waste)",
        "de": "zu (dumm|blod|dammlich) (um|zum|fur); wie kann man (nur |)so (dumm|blod) sein; (dummer|bloder) als; besser als du; eine schande fur; nicht ganz dicht; kein (hirn|gehirn|ruckgrat); scheisse im kopf; geh sterben; scheiss auf (dich|euch); so (ein|einen) (dreck|scheiss); dein (dreck|scheiss|gestammel|geschwatz); was fur ein (idiot|trottel|versager|penner); "
        "(verpiss|fick|verzieh) dich; halt (|doch |endlich )(die|deine|dein|das) (klappe|fresse|maul|schnauze); leck mich am; fahr zur holle; scher dich zum teufel; stuck (scheisse|dreck); hurensohne; fick deine; du kannst mich mal am",
        "fr": "tu me fais (vomir|gerber|chier|pitie); bande de (cons|nuls|incapables|abrutis|cretins|connards); fous (moi |)le camp; trop (bete|con|stupide) pour; plus (bete|con|nul) que; (travail|code|chiffres|tableau|idees|mails) de merde; quel (con|connard|abruti|nul|incapable); honte (a|de) toi; "
        "va te faire (foutre|voir|enculer); va (au diable|crever|mourir|chier); (pauvre|sale|gros|grosse|petit) (con|conne|type|merde|porc|chien|idiot|cretin|folle|tache|pute|race); ta gueule; (ferme|fermez) (la|ta|vos|votre) (|sale )(gueule|bouche); ferme la; nique (ta mere|ta race|toi); fils de (pute|chien|chienne); espece d(e|) (con|merde|porc|cretin|debile|salope|abruti|imbecile|idiot|ordure); "
        "je t emmerde; tu me degoutes; (sac|tas) (a|de) merde; casse toi; degage (connard|pauvre|sale)",
        "es": "mas (tonto|tonta|burro|inutil|idiota) que; demasiado (tonto|tonta|idiota) para; no sirves para nada; das (pena|verguenza|asco); me cago en (tu|tus|la|vuestra); tu puta madre; cara de (culo|mierda); de mierda; panda de (inutiles|idiotas|vagos|imbeciles); hijos de la gran; que (asco|verguenza) das; "
        "(vete|iros|vayase) (a la mierda|al diablo|al infierno|a tomar por culo); (hijo|hija|hijos) de (puta|perra); (pedazo|trozo|saco) de (mierda|animal|idiota); (callate|cierra) (la|tu) (boca|bocaza|puta boca); que te (jodan|den|follen); me das asco; chinga tu madre; la concha de tu madre; vete al carajo",
        "nl": "te (dom|stom) om; (dommer|stommer) dan; geen (hersens|ruggengraat); ga dood; wat een (prutser|sukkel|eikel|lul|idioot|trut); schaam je; "
        "(hou|houd) (je|jouw|die) (bek|mond|kop|smoel|bakkes); (rot|sodemieter|donder|flikker|pleur) op; krijg (de|toch de|een) (kanker|tering|tyfus|pest|klere|dood); val dood; stuk (stront|vreten|ongeluk); kus mijn (kont|reet)",
    },
    "hate": {
        "en": "(worse|lower) than animals; the only good (<race>) is a dead; (not|no) (real|proper|true) (people|humans); (do|does) not belong (here|among|in our|in this country); hang them all; shoot them all; kill them all; burn them all; deport them all; round them up; (pure|dirty|bad|mixed|inferior) (blood|race|breed); of (that|their|dirty) (blood|race|breed|kind); (their|that) kind (is|are|should|must|will|does|do|has|have|never|cannot); (breed|breeding|spread|spreading|swarm) like (rats|vermin|a plague|locusts|maggots); infest (our|this|the) (country|city|town|streets|land); keep (our|this) (country|city|race|blood) (clean|pure|white); should never be allowed to (breed|vote|live|breathe); (steal|stealing|take|taking) our (jobs|women|money|homes); "
        "(driven|thrown|kicked|chased|hounded|throw them|kick them|throw them all|kick them all) out of (this|the|our) (country|land|city|town|nation|continent); (breed|breeding|multiply|multiplying|swarm) like (rats|rabbits|vermin|flies|cockroaches|lice); (wipe|gas|hang|exterminate|lynch|drown) (them|that lot|the lot of them|that tribe)(| all| out); wipe them (all |)out; "
        "(sterilise|sterilize|castrate|exterminate) (them|the whole|all); in (sealed|cattle) (wagons|trains|cars); back (where|to where) (you|they) (came|come|crawled) from; back to the (jungle|desert|gutter|sewer|trees); not (really |even |)(human beings|humans)(| like us); (inferior|lower|lesser) (race|races|breed|people|humans); go back to (africa|your country|where you|your own); "
        "(rotten|filthy|dirty|stinking) (tribe|race|breed|foreigners|immigrants|jew|jews|savages|blood); (kill|gas|hate|exterminate|deport|ban) (|all |the |all the |these |those )(jews|muslims|gypsies|refugees|immigrants|foreigners|arabs|blacks|gays|lesbians|christians|asians|africans|poles|turks|mexicans|homosexuals); white power; heil hitler; sieg heil",
        "de": "(dreckiges|unreines|schlechtes) blut; (solche|diese|die) leute sind keine; (gehen|geht|geh) (doch |)zuruck (in euer|in dein|nach hause|in eure|wo); (aus|aus unserem) land (jagen|werfen|gejagt|geworfen); vermehren sich wie; kein mensch braucht (die|diese|solche); "
        "keine (richtigen |echten |)menschen; (gehoren|gehort|muss man|mussen|sollte man|sollten|sollen) (|alle )(vertrieben|vergast|ausgerottet|erschossen|abgeschoben|vernichtet|aufgehangt|verjagt|totgeschlagen|ins gas); (raus|weg) mit (den|dem|diesem|dieser|diesen|euch) (auslandern|pack|gesindel|leuten|juden|turken|zigeunern); auslander raus; juden raus",
        "fr": "(rentre|rentrez|retourne|retournez) (chez (toi|vous|eux)|dans (ton|votre|leur) pays); hors de (notre|ce) pays; (se reproduisent|pullulent) comme; "
        "(qu on|il faut|on devrait|faut) (les|tous les) (chasse|chasser|expulser|exterminer|gazer|tuer|bruler|pendre|eliminer|virer); qu on les (chasse|expulse|extermine|gaze|tue|brule|pende|vire); sale (race|etranger|juif|arabe|negre); dehors les (etrangers|arabes|juifs)",
        "es": "(vuelve|vuelvan|vete|que se vayan) a (tu|su) pais; fuera de (nuestro|este) pais; se reproducen como; (sangre|raza) (sucia|inferior|de ratas); gentuza; "
        "(hay que|habria que|deberian|tenemos que) (echarlos|expulsarlos|exterminarlos|matarlos|eliminarlos|quemarlos|gasearlos|fusilarlos); (asqueroso|asquerosos|sucio|sucios) (extranjero|extranjeros|inmigrantes|moros|judios); fuera (los|todos los) (moros|inmigrantes|extranjeros)",
        "nl": "(terug|rot op) naar (je|hun) eigen land; ons land uit; planten zich voort als; (vuil|smerig) (bloed|ras|volk); "
        "weg ermee; weg met (die|dat|deze|dit) (lui|tuig|volk|mensen|buitenlanders); (moeten|moet|horen|zouden) (|ze |allemaal )(uitgeroeid|vergast|verdreven|afgemaakt|opgehangen|het land uit); eigen volk eerst",
    },
    "threat": {
        "en": "you (will|ll|are going to) (be sorry|regret (it|ever|being))(|you); teach you a lesson you; (nobody|noone|no one|they) will (ever |never )(find|recognise|recognize) (your body|you); (dance|spit|piss) on your grave; (hope|wish) (your|somebody|someone) (<kin>|stabs|shoots|kills|beats|rapes|runs) (die|dies|you|gets|get|over); (hang|hanging|swing) from (a|the|the nearest) (tree|lamppost|lamp post|rope|ceiling); end up in (hospital|a ditch|a wheelchair|the river|the morgue|a coffin|a body bag); in a body bag; with a (baseball bat|hammer|knife|gun|axe|shotgun|crowbar) in (my|his|the) hand; accidents happen; be a shame if; how brave you are when; (pray|beg) for (mercy|your life); you are next; last (day|breath) on earth; smash your windows; cut your brakes; "
        "(hunt|track) you down; (slit|cut) your throat; (gouge|rip|tear|scratch) (your eyes out|out your <limb>); beat (you to death|you to a pulp|the crap out of you|the shit out of you); make you (pay|suffer|bleed|beg|regret); (bullet|knife) (in|through|into) your (head|skull|back|heart|throat|chest); "
        "know where (you|your <kin>) (live|lives|park|work|works|sleep|sleeps|go|goes|shop|drink|jog|walk|eat|play|are staying); (coming|come) for you (|and )(soon|tonight|you|now|at night|your family); your (<kin>) (go|goes|walk|walks|walking) (to|home from|home) (school|kindergarten|work) alone; (wait|waiting) for you (after work|outside|at your (home|house|door|car)|in the dark|in the car park|behind|one night|one evening|when you leave) and; "
        "you (will|shall|are going to|ought to|deserve to|should) (bleed|die|suffer|burn|choke|hang|rot|be dead|scream)(| for| in| like| slowly| soon); you (will|are going to) pay (for this|dearly|with your|with blood); (deserve|deserves) to be (shot|hanged|beaten|stabbed|killed|whipped|raped|stoned|gassed|sacked); you (should|ought to|need to) be (shot|hanged|beaten|stabbed|killed|whipped); you will (eat|swallow|lose|spit out) your (own |)teeth; "
        "(burn|set fire to|torch|blow up) (your|down your|you and your) (house|home|car|flat|family|office); (kill|hang|shoot|drown) yourself; jump (off|from) (a|the) (bridge|roof|cliff|building); (wish|hope) you (were dead|die|rot|choke|burn|get cancer|bleed|suffer|drown|never wake up); better off dead; die in a fire; "
        "nobody would (notice|miss you|care|cry) if you (were gone|were dead|died|vanished|disappeared); check your brakes; (watch|mind) your back (when|you|or|if|tonight|from); sleep with one eye open; you are (dead meat|a dead man|a dead woman|as good as dead); youre (dead|dead meat); you re (dead|dead meat); your days are numbered; put you in (hospital|the hospital|a wheelchair|the ground|a coffin|a grave); (dig|digging) your (own |)grave; "
        "you (wont|won t|will not|shall not) (live to|wake up|see (tomorrow|another day)|leave here alive|get out alive); (shame|pity) if (something|anything) happened to (her|him|them|you|your)",
        "de": "(du wirst|ihr werdet) (es|das) (noch |bitter |)bereuen; (ich|wir) (finde|finden|krieg|kriege|kriegen) dich; warte nur bis; wart nur; unter die erde; (im|ins) krankenhaus (bring|landest|bringen|landen); tanze auf deinem grab; mit einem messer auf dich; hoffentlich (stirbst|verreckst|krepierst) du; ich hoffe du (stirbst|verreckst|krepierst); (dir|dich) passiert noch was; "
        "(schlag|schlage|prugel|prugle|hau|haue|stech|steche|knall|knalle|mach|mache|bring|bringe) (dich|euch) (tot|um|kalt|fertig|ab|nieder|krankenhausreif|zusammen|windelweich); ich (vernichte|tote) (dich|euch); (ich weiss|wir wissen) wo (du|deine kinder|deine familie|deine frau|dein auto) (wohnst|parkst|arbeitest|schlafst|zur schule|steht|wohnt|wohnen|lebst); "
        "(brech|breche|schneid|schneide|schlag|schlage|polier|poliere) dir (|alle |die |das |den |deine |jeden )(finger|knochen|genick|nase|beine|hals|zahne|kehle|fresse|schadel|visier); du (wirst|sollst) (|dafur |noch |bald )(sterben|bluten|bussen|krepieren|verrecken|leiden|bereuen); (krepier|verreck|verrecke|bring dich um); deine tage sind gezahlt",
        "fr": "tu (vas|va) (le |)(regretter|payer); je vais te (retrouver|faire la peau|demonter|regler ton compte|faire payer); fais gaffe (a toi|en sortant); j espere que tu (vas |)(crever|creves|meurs|mourras); te faire la peau; danser sur ta tombe; "
        "(casser|peter|exploser|defoncer|briser|fracasser) (la|les|ta|tes) (gueule|tete|dents|jambes|doigts|figure|os|genoux); (je sais|on sait|nous savons) ou (tu|vous|tes enfants|ta famille|ta femme) (habites|habitez|travailles|dors|vis|vont|habite|gares); tu vas (crever|mourir|saigner|souffrir|le regretter|le payer)(| cher| de| je); je te (tuerai|creverai|saignerai|casserai|buterai); (va te pendre|va te tuer|creve salaud|creve ordure|creve charogne)",
        "es": "te (vas a arrepentir|arrepentiras); te voy a (encontrar|hundir|joder|dar una paliza|hacer pagar|partir en dos); una paliza; vas a acabar (mal|en el hospital|muerto); ojala (te mueras|revientes|te pudras|te maten); bailare sobre tu tumba; "
        "(te voy a|voy a|te vamos a|vamos a) (matar|matarte|partir|partirte|romperte|reventar|rajar|pegarte|quemarte|degollar|estrangular|destrozarte|apunalar|machacar); (partir|romper|reventar|destrozar|partirte|romperte) (la|los|las|tu|tus) (cara|dientes|piernas|dedos|boca|cabeza|huesos|nariz); (se|sabemos) donde (vives|trabajas|aparcas|duermes|viven tus|estudian tus|vive tu); (vas a|lo vas a|pagaras|lo pagaras) (pagar con sangre|morir|sangrar|con tu vida|con sangre|con la vida); (te matare|te mato|te rompo la|te parto la|muerete|ojala te mueras|matate); quemarte la casa",
        "nl": "je (krijgt er|zult er|gaat er) (nog |)spijt van (krijgen|hebben)(| klootzak); (ik|we) (weet|weten) je te vinden; kijk maar uit; ik hoop dat je (sterft|doodgaat|crepeert|verrekt); dans op je graf; "
        "(ik|we|wij) (sla|schop|trap|maak|steek|schiet|ros|ram|timmer|snij) (je|jullie|jou) (dood|kapot|af|neer|overhoop|in elkaar|verrot|open|bewusteloos|het ziekenhuis in); (sla|maak|schiet|steek|schop) je (dood|kapot|neer|overhoop); ik (vermoord|wurg) (je|jou|jullie); (ik weet|we weten|wij weten) waar (je|jij|jullie|je kinderen|je auto) (woont|parkeert|werkt|slaapt|wonen|staat|naar school); (breek|sla) je (benen|vingers|nek|tanden|kaak|botten|armen); je gaat (eraan|dood|sterven|boeten|bloeden); (maak|hang) jezelf (van kant|op)",
    },
    "sexual": {
        "en": "(on|down on|get on) your knees (for me|and|in front|under|before me|now|tonight); bend (you )(over|over my); bend over; (in|into|share) my bed (tonight|with|and|naked|you); (sleep|spend the night|have sex|go to bed) with me; make love to you; make you (moan|scream|come|wet|squirt); what are you wearing (under|right now|tonight); take off your (clothes|dress|blouse|panties|bra|skirt|shirt|pants); without (panties|a bra|underwear|knickers); no (panties|bra|knickers); (in|your) (lingerie|underwear|bikini|thong) for me; sexual favours; sexual favors; cup size; how big are your; (dirty|naughty) (girl|slut|talk|little girl|boy); all over your (body|face|tits|skin|breasts); every inch of (you|your); (hot|hard|wet) for you; touch myself; touch you (there|everywhere|all over); (so|really|damn) fuckable; "
        "(want|wants|wanted|love|need|going|gonna|like|dying|ready) to (fuck|lick|undress|shag|bang|spank|grope|strip|taste|have sex with) (you|her|him|tonight|me); (wants|want|ready|looking|waiting) to fuck; fuck (me|her|him) (tonight|now|hard|all); i want you (naked|nude|on your knees|in my bed|wet|undressed|bent over|on top of me); "
        "(naked|nude|undressed) (on|in|under|across|over|before) (my|your|our) (bed|desk|bench|knees|lap|table|arms|sofa|car|office|room|sheets); (send|show|give|mail) me (|some |a |your |more )(nudes|nude|naked|tits|boobs|pussy|breasts|panties); (nude|naked|topless|dirty) (<pics>) of (you|yourself|her|your|hot|women|girls|him); (<pics>) of your (tits|boobs|ass|pussy|naked|body|legs|breasts); "
        "up your (skirt|thighs|dress|blouse); (down|under|inside|into) your (blouse|bra|pants|panties|skirt|knickers); between your (legs|thighs|tits|breasts); my (tongue|cock|dick|lips) (on|in|up|down|between|all over|over|inside|along|into) (your|you); (bet|hope) you are (|so |already |all )(wet|horny|dripping|naked); you are (|so |already )(horny|dripping)(| just| for me); "
        "(lonely|horny|bored|cheating|naughty|sexy|hot) (wives|girls|milfs|teens|housewives|singles|babes|moms|women|ladies|students) (near|in your|want|wants|waiting|looking|online|tonight|from|next|are|who); (uncensored|hardcore|xxx|porn|adult|sex) (videos|video|pics|clips|movies|cams|chat|photos|site|content); (blow|hand|rim) job; (suck|lick|ride|stroke) my (cock|dick|balls|tits|prick|penis); suck my; suck you (dry|off); "
        "(come to|meet me in|wait in) my (hotel room|bed|bedroom) (tonight|naked|and); moan (my name|for me); (rip|tear|peel) off your (clothes|dress|blouse|panties|bra|skirt); (nice|great|tight|sweet|sexy) (ass|tits|boobs|butt|rack); (stare|look) (at|down) your (legs|cleavage|breasts|chest); lick you",
        "de": "auf die knie (vor|fur|und|mit); (mit mir|zu mir) ins bett; (zieh|zieht) (deine|dein|die|den) (bluse|kleid|hose|rock|kleider|klamotten) aus; (unter|in) deinen rock; ohne (slip|hoschen|bh); deine (lippen|beine|kurven|schenkel) (auf|um|an|zwischen); zwischen deinen (beinen|schenkeln|brusten); (mit dir schlafen|dich vernaschen|dich flachlegen); "
        "(zeig|zeige|schick|schicke) (mir|uns) (|mal |doch )(deine|deinen|dein|ein) (|geile |geilen )(titten|bruste|muschi|arsch|korper|hintern|nacktfoto|nacktbild|schwanz|po); nackt (in|auf|vor|unter|neben|bei) (meinem|meinen|mir|dem|deinem|meiner); (dich|euch) nackt (sehen|haben|in|auf); ich will (dich|mit dir) (|heute nacht |endlich |heute )(ficken|vogeln|schlafen|lecken|ausziehen|bumsen|im bett); (blas|lutsch) (mir|meinen)",
        "fr": "(dans|viens dans) mon lit; a genoux (devant|et|pour); enleve (ta|ton|tes) (robe|culotte|chemise|jupe|vetements|soutien gorge); coucher avec (moi|toi); sous ta jupe; entre tes (cuisses|jambes|seins); sans culotte; "
        "(montre|montrez|envoie) (moi|nous) (|une photo de |des photos de )(tes|ton|vos|ta|des) (seins|nichons|cul|fesses|chatte|photos nue|corps|cuisses); je (te|vous) veux (nue|nu|a genoux|dans mon lit|toute nue); (nue|a poil) (dans|sur|devant) (mon|ma) (lit|bureau|chambre); (te|vous) (baiser|lecher|deshabiller|branler); suce (moi|ma|mon)",
        "es": "en mi cama; de rodillas (ante|delante|y|para); quitate (la|el|las) (ropa|blusa|falda|bragas|sujetador|camisa); (acostarte|acuestate) conmigo; debajo de tu falda; entre tus (piernas|muslos|tetas); sin bragas; "
        "(ensename|muestrame|mandame|ensenanos) (|una foto de |fotos de )(las|tus|los|el|tu) (tetas|pechos|culo|cono|fotos desnuda|cuerpo); te quiero (desnuda|desnudo|en mi cama|follar|de rodillas|comer entera); (desnuda|desnudo) (en|sobre) mi (cama|mesa|despacho); (chupame|comeme) (la|el)",
        "nl": "in mijn bed; op je knieen (voor|en); trek je (bloes|rok|kleren|jurk|broek) uit; met (me|mij) naar bed; onder je rok; tussen je (benen|dijen|borsten); zonder (slip|bh|ondergoed); "
        "(laat|toon) (me |mij |)(je|jouw|die) (tieten|borsten|kut|kont|lichaam|billen|lul) (|eens |nou )zien; (naakt|bloot) (in|op|onder) (mijn|me) (bed|bureau|schoot); ik wil (je|jou|met je) (naakt|neuken|likken|pijpen|uitkleden|naar bed); (pijp|lik) (me|mij|mijn); stuur (me|mij) (een foto|fotos) van je (tieten|borsten|kut|kont)",
    },
}

#: Idioms that threaten or degrade in most sentences but not in all.
NEARLY = (
    "(find|know) (your house|your address|where you live); you will regret (this|that|it); for this i promise; your (<kin>) (go|goes|walk|walks) to school alone; (wait|waiting) for you after work; should be (fired|sacked|locked up|beaten|whipped); shut up; do (us all|everyone|everybody|the world) a favo(u|)r and; whoever (hired|let) (you|that|this); driven out; wiped out; one more word; nice (daughter|wife|kids|family) you have; bet you are; think about that before; slowly and painfully; in the head"
)
#: Words that add to the picture but prove nothing alone.
HINTS = "mierda; merde; scheisse; shit; shitty; bloody hell; bullshit; crap; crowbar; sweetheart; darling; babe; sexy; moaning; thighs; bleed; i swear; uncensored; blood; corpse; hell; damn; foutre; joder; godverdomme; verdammt; lonely wives"

#: What looks like abuse but is technical, medical, legal, a rule about it, or someone's own mistake.
EXCEPTIONS = (
    "idiocy; retardation; stupid mistake; stupid error; stupid question; dumb question; dumb mistake; dumb idea of mine; my stupid; my dumb; stupid me; silly me; how stupid of me; stupid of me; kill the process; kill the job; kill a coffee; kill for a coffee; murder a coffee; murder a beer; "
    "naked oocytes; naked dna; naked mole; naked eye; naked singularity; naked barley; bloody samples; sexual health; abusive language; sex chromosomes; sexual dimorphism; shoot me a note; shoot me an email; dummer fehler; dumme frage; domme fout; domme vraag; erreur bete; question bete; error tonto; pregunta tonta; cancer du sein; du sein; "
    "idiot proof; finger prick; skin prick; prick test; heel prick; blue tits; great tits; coal tits; dumb terminal; dumb bell; dumb waiter; cocktail; salud sexual; cancer de mama; brustkrebs; borstkanker; vermin control; wild ass; smart ass; pain in the ass; ass backwards; cut your losses; burn your bridges; break your fast; cutting the crap; cut the crap; hell of a; big bang; what the hell; damn good; break your head over"
)
