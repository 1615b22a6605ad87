"""Sentences written for the tests without looking at any table.  ``ABUSIVE`` and ``HARMLESS`` served to find gaps of the
lexicon; ``HELD_ABUSIVE`` and ``HELD_HARMLESS`` were written after it was finished and are only counted."""

ABUSIVE = [
    "I'll slit your throat.", "You're a retard.", "I hope you die in a fire.", "What a bunch of clueless morons you lot are.", "Watch your back when you leave the building.", "Only a complete imbecile writes code like that.",
    "We know where you live and we are coming for you.", "You are dumber than a bag of rocks.", "I will make you regret the day you were born.", "Shut your face, nobody wants to hear you.", "Somebody should put a bullet in your head.", "You lying sack of garbage.",
    "I swear I will burn your car tonight.", "You're the most useless person in the department.", "You won't live to see Christmas.", "Go screw yourself.", "I'm going to beat the crap out of you.", "Your brain must be the size of a pea, you halfwit.",
    "Go kill yourself.", "What an absolute tosser your boss is.", "Nice daughter you have, it would be a shame if something happened to her.", "Immigrants are ruining us, throw them all out of our country.", "Those people are nothing but animals.", "Muslims should be banned from breathing our air.",
    "We should gas the lot of them.", "They are subhuman scum.", "Women are too stupid to do science.", "Gays deserve to be stoned.", "Send them back to the jungle they crawled out of.", "That race is a disease.",
    "I want to lick you all over.", "Send me a picture of your tits.", "Nice ass, come to my hotel room tonight.", "I would love to see you naked on my desk.", "Hot singles waiting to suck you dry.", "Your boobs look great in that blouse.",
    "You pathetic excuse for a scientist.", "Get lost, you filthy pig.", "I will find you and break every bone in your body.", "You deserve to be shot.", "The Poles are thieves, all of them.", "Come here and ride my cock.",
    "Halt die Fresse, du Penner.", "Du bist so ein Vollidiot.", "Ich bring dich um.", "Wir wissen, wo du wohnst.", "Ausländer raus, alles Schmarotzer.", "Die gehören alle vergast.", "Zeig mir deinen geilen Arsch.", "Ich will dich nackt sehen.", "Du dumme Kuh.", "Leck mich am Arsch.",
    "Ich werde dich erwürgen.", "Du bist ein wertloses Stück Scheiße.",
    "Ferme ta gueule, connard.", "Tu es vraiment une merde.", "Je vais te tuer.", "On sait où tu habites.", "Ces gens sont des parasites, dehors.", "Sale pute.", "Envoie-moi une photo de tes seins.", "J'ai envie de te baiser.", "Espèce d'abruti.", "Va crever.",
    "Tu vas le payer de ton sang.", "Quel imbécile, ce chef de service.",
    "Cállate, imbécil.", "Eres una basura.", "Te voy a matar.", "Sabemos dónde vives.", "Esos inmigrantes son ratas.", "Hijo de puta.", "Mándame fotos de tus tetas.", "Quiero follarte.", "Vete al infierno, cabrón.", "Ojalá te mueras.", "Tu jefe es un gilipollas.", "Vamos a quemarte la casa.",
    "Hou je bek, klootzak.", "Je bent een waardeloze sukkel.", "Ik maak je af.", "We weten waar je woont.", "Die buitenlanders zijn uitschot.", "Vieze hoer.", "Stuur me een foto van je tieten.", "Ik wil je neuken.", "Rot op, eikel.", "Krijg de tering.", "Ik ga je vermoorden.", "Wat een lul is die man.",
]

HARMLESS = [
    "The bastard wing of the bird is short.", "The bitch was mated in March and whelped in May.", "The prick of the needle hurt a little.", "We killed the zombie processes on the node.", "The parent killed the child process.", "I will kill the job if it hangs again.", "Please abort the execution of the script.",
    "She works on cockroaches and other parasites.", "The rats were sacrificed under anaesthesia.", "Breast cancer screening starts at fifty.", "Sexual transmission of the virus was studied.", "The rape crisis centre published its yearly report.", "Oilseed rape flowers in May.",
    "Mental retardation is the term of the old code list.", "Our policy forbids words such as idiot or bitch.", "Please report threats and insults to the ombudsman.", "I was an idiot and forgot the attachment.", "Sorry, stupid me, I attached the wrong file.", "My dumb script overwrote it.", "How stupid of me.",
    "Blue tits and great tits nest in May.", "The cock crows at dawn.", "Dick Turner will join the call.", "Pussy willow grows by the river.", "Shoot me an email when you are done.", "I could kill for a coffee.", "Break a leg at the talk!", "Break your data into chunks.", "Cut your costs by half.", "Your children are welcome at the summer party.",
    "We will hunt down the bug.", "That bug is driving me crazy.", "Naked mole rats live long.", "It cannot be seen with the naked eye.", "Strip the adapters and trim your reads.", "The virus attacks the host and kills it.", "The hanging node was shot by the scheduler.", "Dead code should be removed.", "The replicas disagree with the master.", "These two genes are hot spots.",
    "The patient was stabbed in the neck; see page three.", "Homicide by strangulation has a code of its own.", "Please fill in the registration form for foreigners.", "Refugees and immigrants were included in the cohort.", "The founder population of Ashkenazi Jews carries this variant.", "Blacks and whites differ in the frequency of this allele.", "Vaginal swabs were taken at week twelve.", "The penis bone was measured twice.",
    "You are too kind.", "You will find the file on your desk.", "We will wait for you at the station after work.", "They are animals that live in groups.", "They should be removed from the list.", "I will send you and your family the photos.", "Your hands are needed in the lab.", "You are such a great help.", "The worm infects dogs, pigs and rats.", "Smoking will kill you, says the leaflet.",
    "Send them back to the supplier.", "I will beat you to the deadline.", "The assessment of cockpit assistants is classified.", "Scunthorpe sent three samples.",
    "Der Prozess wurde abgeschossen.", "Die Ratten wurden gegen Parasiten behandelt.", "Ich Idiot habe den Anhang vergessen.", "Ungeziefer im Lager bitte sofort melden.", "Brustkrebs wird früh erkannt.", "Das war dumm von mir.", "Ich schlage vor, dass wir uns morgen treffen.", "Du schlägst dich gut.", "Ich bringe dich zum Bahnhof.", "Wir wissen, wo der Fehler liegt.",
    "J'ai été bête, pardon.", "Le cancer du sein est fréquent.", "Les rats sont traités contre la vermine.", "Je vais te montrer le tableau.", "Tu vas recevoir le fichier demain.", "On va couper le fichier en deux.", "Vous êtes trop aimable.", "Je sais où tu as mis le fichier.",
    "Fui tonto, perdón.", "El cáncer de mama es frecuente.", "Las ratas del laboratorio son animales sanos.", "Te voy a enviar la tabla.", "Voy a romper el archivo en partes.", "La basura se recoge los lunes.", "Eres muy amable.", "Sabemos dónde está el error.",
    "Dom van mij.", "Borstkanker komt vaak voor.", "De ratten zijn gezonde dieren.", "Ik sla je voorstel op.", "Ik stuur je de tabel.", "Je hoort morgen van ons.", "Je bent een grote hulp.", "We weten waar de fout zit.",
]

HELD_ABUSIVE = [
    "One of these nights we are going to strangle you in your sleep.", "You spineless little rat, I despise you.", "If you send that again I will knock your teeth out.", "He is a complete and utter bastard and so are you.", "I hope you get cancer.", "Nobody would care if you died.",
    "Gypsies are thieves and should be driven out of this town.", "The refugees are parasites.", "Keep your dirty race away from our children.", "All foreigners are criminals.", "Lesbians should be castrated.", "Your kind breeds like cockroaches.",
    "I dream of licking your legs every night, baby.", "Show me your tits or you lose your job.", "She has huge boobs and I want to grope her.", "You make me so horny.", "Free porn, click here to see naked girls.", "I would fuck you right here on the desk.",
    "What kind of moron wrote this?", "You stupid cow, read the manual.", "Are you really that dumb?", "You cannot be this stupid, you cretin.", "Fuck you and your whole team.", "You disgust me, you filthy liar.",
    "Du bist ein hirnloser Affe.", "Ich schlag dir die Zähne aus.", "Juden raus!", "Fick dich, du Hurensohn.", "Deine Brüste machen mich geil.", "Ihr seid alle Abschaum.", "Du blöder Idiot.", "Wir bringen euch um.",
    "Tu es complètement débile.", "Je vais te casser la gueule.", "Les immigrés sont de la racaille.", "Suce ma bite.", "Va te faire enculer.", "Pauvre con.", "On va te buter.", "Montre ton cul.",
    "Eres tonto de remate, imbécil.", "Te voy a romper la cara.", "Los gitanos son escoria.", "Chúpame la polla.", "Vete a la mierda.", "Cierra la boca, cerda.", "Alguien debería matarte.", "Enséñame el culo.",
    "Jij vieze klootzak.", "Ik sla je in elkaar.", "Marokkanen zijn tuig.", "Laat je borsten zien.", "Krijg de kanker.", "Stomme trut.", "Ik weet waar je kinderen naar school gaan, pas maar op.", "Je bent zo dom als het achtereind van een varken.",
]

HELD_HARMLESS = [
    "The patient's throat was examined and found clear.", "I will send you the skull measurements tonight.", "Her husband hit his head and was taken to hospital.", "The gut flora of pigs and cows differ.", "This scum forms on the pond in summer.", "The parser chokes on empty lines.",
    "A stupid typo cost us two days, my fault.", "Cancer patients and their families were invited.", "Please strip the names before you share the table.", "The males fight and bite each other's tails.", "The dog ate my homework.", "Do not insult anyone on this list; the rules are on the wiki.",
    "The script dies with exit code nine.", "We slaughtered twelve pigs under the permit.", "The breasts of the birds are white.", "Sex and age are covariates.", "We will beat last year's record.", "He hung up before I could answer.",
    "You are dead right about the index.", "You will pay the invoice by Friday.", "I know where you put the samples.", "The fool's gold was analysed.", "The burn rate is too high.", "Your head of department must sign.",
    "This is the worst table I have ever made, sorry.", "I hate Mondays.", "Kill two birds with one stone.", "I am dying to see your results.", "The vermin in the cellar were removed by the company.", "The foreign body was removed from her eye.",
    "Die Hunde wurden geimpft.", "Du bist jetzt im Verteiler.", "Ich weiß, wo das Protokoll liegt.", "Der Hund hat dich gebissen?", "Das ist ja blöd gelaufen.", "Bitte schlag einen Termin vor.",
    "Tu es très gentil.", "La vermine a été éliminée de la cave.", "Je vais te rappeler demain.", "Le chien est malade.", "Quelle mauvaise journée.", "On sait où sont les erreurs.",
    "Eres la mejor colega.", "Las cucarachas se estudian aquí.", "Voy a matar el proceso.", "El perro está enfermo.", "Qué mala suerte.", "Te voy a llamar mañana.",
    "Je bent een schat.", "De hond is ziek.", "Ik maak je taart morgen.", "Wat een pech.", "Je zult de tabel morgen krijgen.", "De parasieten werden geteld.",
]
