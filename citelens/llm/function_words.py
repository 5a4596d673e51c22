"""Frequent function words of ten languages: articles, pronouns, prepositions, conjunctions, auxiliaries and adverbs of degree."""

from __future__ import annotations

# Fixed values.
WORDS = {
    "de": "der die das den dem des ein eine einen einem einer eines kein keine keinen keiner ich du er sie es wir ihr mich dich "
    "ihn uns euch mir dir ihm ihnen sich man mein dein sein seine seinen seiner ihre ihren ihrer unser dieser diese dieses "
    "diesem diesen jeder jede jedes jener solche welche welcher was wer wen wem wessen und oder aber denn sondern doch als wie "
    "wenn weil dass da ob obwohl damit während bevor nachdem seit sobald solange sofern falls bis an auf aus bei durch für "
    "gegen hinter in im ins am ans beim mit nach neben ohne über um unter von vom vor zu zum zur zwischen wegen trotz statt "
    "laut innerhalb außerhalb ist sind war waren wird werden wurde wurden hat haben hatte hatten kann können muss müssen soll "
    "sollen darf dürfen will wollen mag nicht auch nur noch schon sehr mehr so dann hier dort nun zwar sogar etwa ja nein",
    "en": "the a an and or but nor so if because as than that which who whom whose what when where while although though until "
    "unless since of in on at by for with from to into onto about over under between through during before after above below "
    "against without within is are was were be been being am has have had having do does did can could will would shall should "
    "may might must not no i you he she it we they me him her us them my your his its our their this these those there here",
    "fr": "le la les un une des du de au aux et ou mais donc car ni si que qui quoi dont où quand comme parce lorsque puisque "
    "quoique je tu il elle nous vous ils elles on me te se lui leur leurs mon ma mes ton ta tes son sa ses notre votre ce cet "
    "cette ces à dans en par pour sur sous avec sans chez entre vers contre depuis pendant avant après est sont était été être "
    "a ont avait avoir ne pas plus très aussi même",
    "es": "el la los las un una unos unas de del al y e o u pero sino que quien cual cuyo donde cuando como porque aunque si yo "
    "tú él ella nosotros ellos ellas me te se lo le les nos mi tu su sus nuestro este esta estos estas ese esa aquel a ante "
    "bajo con contra desde durante en entre hacia hasta para por según sin sobre tras es son era fue ser está están ha han "
    "había no más muy también ya",
    "pt": "o a os as um uma uns umas de do da dos das no na nos nas ao aos à às pelo pela e ou mas que quem qual onde quando "
    "como porque embora se eu tu ele ela nós vós eles elas me te lhe lhes meu teu seu sua seus suas nosso este esta esse essa "
    "aquele isto isso com contra desde em entre para por sem sob sobre até após é são era foi ser está estão tem têm não mais "
    "muito também já",
    "pl": "i a oraz lub albo ale lecz jednak że żeby aby bo ponieważ gdy kiedy jeśli jeżeli choć niż jak który która które co "
    "kto ja ty on ona ono my wy oni one mnie mi ciebie jego jej ich się mój twój swój nasz ten ta to tego tej tym te w we na "
    "z ze do od dla po pod nad przed przy przez bez między za o u jest są był była było były być będzie ma mają nie tak już "
    "tylko także też bardzo",
    "cs": "a i nebo ale avšak že aby protože když pokud jestliže než jak který která které co kdo já ty on ona ono my vy oni "
    "mě mi tě ti ho jeho jí její jim jich se si můj tvůj svůj náš ten ta to toho té tom ty v ve na z ze do od pro po pod nad "
    "před při přes bez mezi za o u s k je jsou byl byla bylo byli být bude má mají ne ano už jen také velmi",
    "tr": "ve veya ya da ama fakat ancak çünkü ki eğer gibi kadar için ile göre sonra önce beri rağmen karşı ben sen o biz siz "
    "onlar beni seni onu bana sana ona benim senin onun bizim sizin bu şu bunu bunun bir her hiç bazı çok daha en az ne kim "
    "nasıl neden nerede hangi mi mı mu mü değil var yok olan olarak olduğu ise de",
    "ru": "и а но или да не ни что чтобы как когда если хотя потому так же бы ли то я ты он она оно мы вы они меня тебя его её "
    "ему ей нас вас их мне себя свой мой твой наш ваш этот эта это эти тот та те кто который которая в во на с со к ко у о об "
    "от до из за по под над при для без между через перед после был была было были быть есть нет уже ещё только очень также",
    "el": "ο η το οι τα τον την του της των τους τις στο στη στην στον στα και ή αλλά όμως ότι που να θα δεν μην αν όταν ενώ "
    "επειδή γιατί όπως εγώ εσύ αυτός αυτή αυτό εμείς εσείς αυτοί με σε από για προς κατά μετά πριν χωρίς μεταξύ είναι ήταν "
    "έχει έχουν ένα ένας μια πολύ πιο μόνο επίσης",
}
SETS = {language: frozenset(words.split()) for language, words in WORDS.items()}
ALL = frozenset().union(*SETS.values())
