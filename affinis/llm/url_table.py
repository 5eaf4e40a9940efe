"""The labelled URLs that the URL filter learns from, written down by hand: no
host is repeated, unwanted hosts are invented, ordinary ones are invented or
well-known public sites. Among the ordinary are many that share parts of words
with unwanted ones."""

from __future__ import annotations

UNWANTED = """
adult: hotpornvideos.com/watch/8812 freepornclips.net/ xxxmovies-hd.org/category/milf sexcamslive.tv/room/lily nudegirlsdaily.com/gallery/12
 pornstarvideos.xyz/video/991 camgirls4u.live/ teenxxxpics.biz/album/3 eroticstories-porn.com/story/44 hardcoresextube.net/v/72 milfpornhub.club/
 nakedwebcamgirls.com/models hentaixxx.site/manga/7 sexyescorts-paris.fr/annonces escortgirls-london.co.uk/profiles/anna adultfriendchat.com/join
 xxx-filme-gratis.de/ pornogratis-español.es/videos videospornoamateur.com.mx/ver/18 sexkontakte-privat.de/anzeige/81 gaypornlinks.org/top
 fetishcams.xxx/ bigboobspics.net/set/9 sexfilme24.info/kategorie/amateur onlynudes-leaks.com/leak/55 swingersexparty.net/events lesbianxxxclips.com/17
gambling: bestonlinecasinobonus.com/welcome slotsjackpot777.net/play royalpokerroom.org/tables betting-odds-today.com/football
 luckyspinslots.win/bonus freespins-casino.co/claim livecasinoroulette.com/lobby mobilebetting.bet/app vegasblackjack-online.net/ sportsbetking.com/odds
 megajackpotslots.club/spin bitcoincasino-bonus.io/ onlinewetten-bonus.de/tipps casinoenligne-gratuit.fr/jeux casinos-online-bonos.es/tragaperras
 pokerbonuscodes.org/codes bingocash-online.uk/rooms baccaratwinners.com/strategy betnow365.asia/live judi-slot-gacor.site/daftar togel-online88.net/
 spielautomaten-kostenlos.net/book footballbettingtips.win/today winrealmoneyslots.com/ crapsandroulette.net/rules casinohighroller.vip/vip
pharma: buyviagracheap.com/order cialis-generic-online.net/ onlinepharmacy-noprescription.com/pills cheapmedsdirect.biz/xanax
 weightlosspills-fast.com/ ketodietmiracle.shop/buy buytramadol-overnight.org/checkout hairlosscure-secret.com/ maleenhancementpills.store/trial
 canadianpharmacydeals.net/levitra steroids-for-sale.biz/cycle viagra-ohne-rezept.de/kaufen potenzmittel-günstig.net/ pastillas-adelgazar.es/oferta
 acheter-cialis-pascher.fr/commande modafinil-shop.pw/ phentermine-online.us/order garcinia-slim.club/free-trial cbdgummies-discount.shop/ botoxathome.biz/
money: fastpaydayloans-online.com/apply badcreditloans-now.net/ getrichquick-system.biz/secret makemoneyathome-daily.com/join
 bitcoindoubler.io/invest cryptoinvest-profit.club/register forexmillionaire.club/signals binaryoptions-robot.com/ passiveincome-hack.net/
 earn-cash-surveys.com/start instantcashadvance.us/apply debtrelief-miracle.org/ hyip-invest-monitor.biz/plan doubleyourbtc.top/ richtraders.vip/
 kredit-ohne-schufa-sofort.de/antrag ganar-dinero-facil.es/ya argent-facile-internet.fr/ pyramidprofits.club/ airdropgiveaway-eth.top/claim mlmsuccess-secret.net/
scam: winner-prize-claim.com/iphone free-giftcard-generator.net/ account-verify-login.info/secure paypa1-security-update.com/signin
 your-pc-is-infected.online/alert freeiphone-winner.club/survey bank-login-confirm.top/verify appleid-unlock.support/login claimyourreward.win/now
 lottery-winner-notice.org/ urgent-refund-tax.info/form microsoft-support-alert.tech/call congratulations-prize.xyz/spin netflix-billing-update.info/pay
 gewinnspiel-iphone-gratis.de/teilnehmen regalo-gratis-ganador.es/premio cadeau-gagnant-gratuit.fr/ package-delivery-fee.top/track secure-wallet-restore.app/seed
piracy: freemoviedownloads-hd.net/ watchmoviesfree123.to/film/8 crackedsoftware-full.com/photoshop serialkeygen.org/windows warezforum.to/thread/8
 torrentmovies-yts.mx/dl appscracked-apk.net/mod free-ebooks-pirate.cc/dl mp3download-gratis.net/song nulledscripts.cc/themes activatorkms.net/office
 streamfootball-free.live/match cracksnow.biz/adobe keygenninja.net/ warez-bb-downloads.org/ filme-kostenlos-stream.to/ peliculasgratis-torrent.net/
 telechargement-films-gratuit.cc/ gamecracks-repack.site/ modapkunlimited.com/coins leakedalbums.biz/zip keys-activation-free.net/win
ads: adserver7.net/click adclicks-exchange.com/banner popunder-network.net/pop trackingpixel.io/px clicktracker-ads.com/redirect
 bannerexchange-ads.net/show affiliateclicks.biz/go retarget-ads.net/sync popads-traffic.com/imp adnetworkmedia.net/serve doubleads.biz/adserve
 clickbank-offers.biz/hop pushnotification-ads.club/sub trafficexchange-hits.com/ adsyndicate.net/js/ads impression-tracker.com/pixel
 cpaoffers-network.com/offer adredirect.top/r sponsoredads-feed.net/feed leadgen-popup.biz/lp telemetry-adtech.io/collect adbeacon.net/b
spam: buybacklinks-cheap.com/order seolinkbuilding-service.biz/ instagramfollowers-buy.net/ bulkemail-sender.com/ autoblog-spam.xyz/post/1
 articlespinner-seo.com/spin buyfacebooklikes.biz/ linkfarmnetwork.net/directory massmailing-software.com/ cheapseotraffic.biz/hits
 commentspammer.net/blast guestpost-links.biz/ doorwaypages.top/ fakereviews-buy.com/ youtubeviews-cheap.net/ spamblaster-mailer.com/ linkspamdirectory.info/
 keywordstuffing.biz/ scrapedcontent.top/p/3 splogfarm.com/ seorankboost-links.net/ junkmail-lists.com/leads
malware: freescreensaver-toolbar.com/install driver-updater-free.net/setup.exe antivirus-scan-online.xyz/scan flashplayer-update-now.top/install
 malwaredropper.pw/payload ransomdecrypt.top/ trojanspy-download.net/rat.exe keylogger-free.org/ botnetpanel.cc/login exploitkit-landing.top/
 pc-cleaner-booster.download/ videocodec-install.win/codec.exe hackaccounts-free.com/facebook ddosbooter.net/stresser stealerlogs.market/
dating: singlesnearyou-chat.com/join hookuptonight-local.net/ russianbrides-dating.com/girls sugardaddymeet.club/ asianbrides-online.net/ladies
 cheatingwives-affair.com/ casualdatingsex.net/signup meetsexysingles.org/tonight flirtchat-hot.com/ onenightstands.club/near ukrainian-brides.love/
 seitensprung-treffen.de/ citas-calientes.es/ rencontre-coquine.fr/inscription milfdating-local.com/ hotsingles-area.club/meet localhookups.top/
goods: replicawatches-rolex.com/submariner cheapuggboots-outlet.biz/ fakedesignerbags.net/louis-vuitton discount-raybans.shop/ nfljerseys-cheap.us/
 replicahandbags-aaa.ru/ buyfakepassport.cc/ counterfeit-ids.biz/order cheapairjordans.store/ replicas-relojes.es/rolex sneakers-replica.top/
 moncler-outlet-sale.biz/ fakediploma-degree.com/buy essaywriters-cheap.com/order buyessays-now.net/ clonecards-shop.cc/ vapejuice-cheap.biz/
psychic: psychicreading-free.net/ lovespells-caster.com/ horoscope-lottery-numbers.biz/ miraclecures-doctorshate.com/ shockingcelebrity-gossip.top/
 youwontbelieve-this.club/ viralclickbait.buzz/slideshow celebritynudeleaks.net/ onetrick-bellyfat.com/ doctors-hate-this.top/ illuminati-join-rich.com/
"""

ORDINARY = """
reference: en.wikipedia.org/wiki/Linear_algebra de.wikipedia.org/wiki/Geschichte fr.wikipedia.org/wiki/Histoire es.wikipedia.org/wiki/Ciencia britannica.com/science/physics
 merriam-webster.com/dictionary/analyse duden.de/rechtschreibung larousse.fr/dictionnaires rae.es/consultas archive.org/details/books
 gutenberg.org/ebooks/1342 wiktionary.org/wiki/therapist worldhistory.org/Rome encyclopedia.com/arts plato.stanford.edu/entries/logic oed.com/view
news: bbc.co.uk/news/world-1 lemonde.fr/article/2021 elpais.com/internacional spiegel.de/politik reuters.com/business apnews.com/article npr.org/sections/science
 theguardian.com/culture/2019 zeit.de/wissen aljazeera.com/news localherald.com/town/council dailycourier.net/sports/match-report valleytimes.org/weather
 eveningpost.ie/opinion tagesblatt.lu/region lavoz.com.ar/ciudadanos ouest-journal.fr/commune weeklybulletin.ca/letters marketwatchers.org/stocks
learning: mit.edu/research ox.ac.uk/admissions uni-heidelberg.de/studium sorbonne.fr/etudes essex.ac.uk/departments/history sussex.ac.uk/library
 middlesex.edu/courses coursera.org/learn/statistics khanacademy.org/math openlearning.edu/syllabus riverside-school.org/timetable
 northcollege.ac.uk/prospectus grammarschool.org/alumni kindergarten-sonnenschein.de/ universidad-salamanca.es/facultad lycee-moliere.fr/cantine
 teachersnetwork.org/lesson-plans scholarship-office.edu/apply studentunion.org/clubs examprep.org/biology languageschool.es/cursos
code: python.org/docs/tutorial docs.rust-lang.org/book github.com/apache/spark stackoverflow.com/questions/11227809 kernel.org/doc postgresql.org/docs/16
 developer.mozilla.org/en-US/docs/Web/HTML go.dev/blog numpy.org/doc/stable sqlite.org/lang.html readthedocs.io/projects algorithms-notes.net/graphs
 bugtracker.dev/issues/81 compilerdesign.org/lexer opendata-portal.org/datasets webanalytics.dev/guide clicklibrary.dev/api hackerspace.org/events
 cracktheinterview.dev/trees keyboardbuilders.net/switches serialport-docs.dev/usb torrentfreedomresearch.org/papers trackerbeats.org/modules
health: who.int/health-topics nhs.uk/conditions/asthma mayoclinic.org/diseases cdc.gov/flu therapistfinder.org/counselling physiotherapy-clinic.de/termine
 familydoctor.org/children pharmacyhistory.org/museum hospital-sanrafael.es/urgencias dentistry-today.net/articles nutritionfacts.org/topics
 sexeducation.edu/teens pillbox-museum.org/wartime medicaljournal.net/issue/7 breastcancer-care.org/support dietitians.org/recipes yoga-studio.net/classes
 mentalhealth-foundation.org/sleep hausarzt-praxis.de/sprechzeiten pharmacie-centrale.fr/horaires weightlifting-club.org/training
science: nasa.gov/missions cern.ch/science nature.com/articles/s41586 esa.int/planets arxiv.org/abs/1706.03762 noaa.gov/tides ornithology.org/birds
 geologysociety.org/maps botanical-garden.org/species titanium-materials.org/alloys astronomyclub.net/eclipse volcano-observatory.is/data
 chemistryworld.com/elements marinebiology.org/corals seti-research.org/signals expedition-log.net/antarctica entomology.org/beetles adaptation-lab.org/
government: europa.eu/legislation usa.gov/taxes gov.uk/council-tax bundestag.de/dokumente senat.fr/rapports cityofspringfield.gov/permits
 countycourt.gov/forms parliament.uk/bills ayuntamiento-toledo.es/tramites mairie-lille.fr/etat-civil stadt-ulm.de/rathaus embassy-ottawa.gov/visa
 taxadvice.gov/returns customs-office.gov/tariff gamblingcommission.gov.uk/reports electoralroll.org/register statistics.gov/census police-museum.org/
travel: lonelyplanet.com/italy nationalparks.org/hiking hotel-bergblick.de/zimmer riverboat-tours.com/schedule islandferry.net/timetable trainspotting.org.uk/lines
 seaside-cottage.co.uk/book airportguide.net/terminals casadelmar-hotel.es/habitaciones gite-provence.fr/tarifs mountainhut.ch/route backpackers.org/asia
 casinosquare-montecarlo.mc/history city-walks.org/lisbon campingplatz-see.de/preise cycleroutes.org/danube railpass.eu/map cruiseharbour.net/ports
food: recipes-from-home.com/soup breadbakers.net/sourdough cookingwithgrandma.org/pies wineregions.fr/bordeaux cheesemakers.org/gouda tapas-recetas.es/tortilla
 backen-leicht.de/kuchen vegetarian-kitchen.net/lentils coffeeroasters.org/beans teahouse.co.uk/menu slowfood.it/presidia spicemarket.org/cumin
 chickenbreast-recipes.com/grilled cocktailhour.org/classics fishmonger.net/salmon restaurant-lepont.fr/carte harvestfestival.org/apples
culture: louvre.fr/collections moma.org/exhibitions operahouse.org/season poetryfoundation.org/poems jazzarchive.net/records folkmusic.ie/tunes
 theatre-royal.co.uk/tickets filmsociety.org/noir photography-forum.net/lenses nudes-in-art-history.org/renaissance museum-fuer-kunst.de/ausstellung
 literature-review.org/essays comicsjournal.net/interviews pottery-guild.org/kilns architecture-digest.net/bridges danceacademy.org/ballet
 museoprado.es/obras cinematheque.fr/cycle bookclub.org/reviews chorus-singers.net/rehearsals calligraphy.org/ink pokerfaces-theatre.org/cast
sport: fifa.com/worldcup olympics.com/athletes cricinfo.com/scores chess.com/openings rowingclub.org/regatta essexcountycricket.org.uk/fixtures yachtclub-kiel.de/regatta
 tennis-verein.de/plan marathon-running.net/plans swimmingteam.org/results ski-alpin.at/pisten rugbyunion.fr/calendrier basketball-school.org/drills
 climbinggym.net/hours judo-club.org/belts fencing-masters.org/foil hockey-league.ca/standings golfcourse-dunes.ie/tee slotcar-racing.org/tracks surfreport.org/waves
business: worldbank.org/indicators imf.org/reports bakery-supplies.com/ovens plumber-leeds.co.uk/contact accountants-institute.org/standards
 carpentry-workshop.net/tables solarpanels.org/installation furniture-makers.co.uk/chairs insurance-advice.org/home autowerkstatt-huber.de/service
 textile-mill.net/history shipping-lines.org/schedule cooperative-bank.coop/branches farmersmarket.org/stalls printing-press.net/orders
 creditunion.org/savings loanlibrary.org/interlibrary moneymuseum.org/coins bitcoin-whitepaper.net/pdf cashregister-history.org/ stockphotos.net/license
 advertising-museum.org/posters bannermakers.co.uk/fabric trackandfield.org/meets adelaide-traders.com.au/ tradesunion.org/pay pillow-factory.com/care
community: gardeningforum.net/roses parents-group.org/advice amateurradio.org/bands knittingcircle.net/patterns birdwatch.org/sightings dogrescue.org/adopt
 neighbourhood-watch.org/meetings genealogy-search.net/surnames chess-problems.org/mate vintagecars.net/rally modelrailway.org/layouts beekeepers.org/hives
 churchofstmary.org/services mosque-centre.org/prayer synagogue-history.org/ volunteers.org/shifts scouts.org/badges allotments.org/plots
 singlemothers-support.org/help brides-magazine.net/dresses escortvessels-navalhistory.org/fleet hotsprings-park.org/trails cam-design.org/gears
 petition-site.org/sign lottery-funding.org/grants prizewinning-gardens.org/shows winterfestival.org/program luckydog-shelter.org/dogs
personal: annas-notebook.net/2021/spring thomas-wrote.com/essays peterandmaria.org/wedding blog.jansen.nl/fietsen lauras-diary.net/entry tomsworkshop.net/lathe
 notesfromthefarm.org/lambing unterwegs-mit-lena.de/island carnet-de-marie.fr/jardin elblogdepablo.es/viajes writing-desk.net/drafts smallthings.org/archive
 thehouseonthehill.net/rooms oldmaps.net/sheet/4 ingrid-andersson.se/bilder weathervane.org/log sandrasquilts.com/blocks northernlights.no/photos
 thinking-aloud.net/page/3 theotherside.org/story antonio-benitez.es/articulos hendersons.net/tree rethinking.org/post stationhouse.net/about
 nathanander.com/item reading-list.net/tag/novels ontheedge.org/topic/9 ereignisse.de/archiv entrance-hall.org/view estherhill.net/thread/2
"""


def rows() -> list[tuple[str, int]]:
    """(url, 1 for unwanted), kind by kind."""
    return [("https://" + url, label) for label, text in ((1, UNWANTED), (0, ORDINARY)) for url in text.split() if not url.endswith(":")]
