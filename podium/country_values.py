"""The default country dictionary (name | iso2 | iso3 | region | other spellings).

The last seven rows are groups of countries. Any table of the same shape can be passed in its place.
"""

COUNTRIES = """
China | CN | CHN | Asia | prc; peoples republic of china; mainland china
India | IN | IND | Asia | bharat; republic of india
United States | US | USA | America | usa; us; united states of america; america; united states
Indonesia | ID | IDN | Asia |
Pakistan | PK | PAK | Asia |
Nigeria | NG | NGA | Africa |
Brazil | BR | BRA | America | brasil
Bangladesh | BD | BGD | Asia |
Russia | RU | RUS | Europe | russian federation; ussr; soviet union
Mexico | MX | MEX | America | mexico
Japan | JP | JPN | Asia |
Ethiopia | ET | ETH | Africa |
Philippines | PH | PHL | Asia |
Egypt | EG | EGY | Africa | egypt
Vietnam | VN | VNM | Asia | viet nam
Democratic Republic of the Congo | CD | COD | Africa | dr congo; drc; congo kinshasa; democratic republic of congo; zaire
Turkey | TR | TUR | Asia | turkiye
Iran | IR | IRN | Asia | islamic republic of iran
Germany | DE | DEU | Europe | deutschland; west germany
Thailand | TH | THA | Asia |
United Kingdom | GB | GBR | Europe | uk; great britain; england; britain
France | FR | FRA | Europe |
Italy | IT | ITA | Europe |
Tanzania | TZ | TZA | Africa | united republic of tanzania
South Africa | ZA | ZAF | Africa |
Myanmar | MM | MMR | Asia | burma
Kenya | KE | KEN | Africa |
South Korea | KR | KOR | Asia | korea; republic of korea; korea south; south korea
Colombia | CO | COL | America |
Spain | ES | ESP | Europe | espana
Argentina | AR | ARG | America |
Algeria | DZ | DZA | Africa |
Sudan | SD | SDN | Africa |
Ukraine | UA | UKR | Europe |
Iraq | IQ | IRQ | Asia |
Afghanistan | AF | AFG | Asia |
Poland | PL | POL | Europe |
Canada | CA | CAN | America |
Morocco | MA | MAR | Africa |
Saudi Arabia | SA | SAU | Asia | ksa
Uzbekistan | UZ | UZB | Asia |
Peru | PE | PER | America |
Angola | AO | AGO | Africa |
Malaysia | MY | MYS | Asia |
Mozambique | MZ | MOZ | Africa |
Ghana | GH | GHA | Africa |
Yemen | YE | YEM | Asia |
Nepal | NP | NPL | Asia |
Venezuela | VE | VEN | America |
Madagascar | MG | MDG | Africa |
Cameroon | CM | CMR | Africa |
Cote d Ivoire | CI | CIV | Africa | ivory coast; cote divoire
North Korea | KP | PRK | Asia | korea north; dprk
Australia | AU | AUS | Oceania |
Niger | NE | NER | Africa |
Sri Lanka | LK | LKA | Asia |
Burkina Faso | BF | BFA | Africa |
Mali | ML | MLI | Africa |
Romania | RO | ROU | Europe |
Malawi | MW | MWI | Africa |
Chile | CL | CHL | America |
Kazakhstan | KZ | KAZ | Asia |
Zambia | ZM | ZMB | Africa |
Guatemala | GT | GTM | America |
Ecuador | EC | ECU | America |
Syria | SY | SYR | Asia |
Netherlands | NL | NLD | Europe | holland
Senegal | SN | SEN | Africa |
Cambodia | KH | KHM | Asia |
Chad | TD | TCD | Africa |
Somalia | SO | SOM | Africa |
Zimbabwe | ZW | ZWE | Africa |
Guinea | GN | GIN | Africa |
Rwanda | RW | RWA | Africa |
Benin | BJ | BEN | Africa |
Burundi | BI | BDI | Africa |
Tunisia | TN | TUN | Africa |
Bolivia | BO | BOL | America |
Belgium | BE | BEL | Europe |
Haiti | HT | HTI | America |
Cuba | CU | CUB | America |
Greece | GR | GRC | Europe | hellas
Jordan | JO | JOR | Asia |
Czechia | CZ | CZE | Europe | czech republic
Portugal | PT | PRT | Europe |
Sweden | SE | SWE | Europe |
Azerbaijan | AZ | AZE | Asia |
Hungary | HU | HUN | Europe |
United Arab Emirates | AE | ARE | Asia | uae
Israel | IL | ISR | Asia |
Switzerland | CH | CHE | Europe |
Austria | AT | AUT | Europe |
Norway | NO | NOR | Europe |
Finland | FI | FIN | Europe |
Denmark | DK | DNK | Europe |
Ireland | IE | IRL | Europe |
New Zealand | NZ | NZL | Oceania |
Singapore | SG | SGP | Asia |
Taiwan | TW | TWN | Asia | chinese taipei
Hong Kong | HK | HKG | Asia |
Serbia | RS | SRB | Europe |
Belarus | BY | BLR | Europe |
Bulgaria | BG | BGR | Europe |
Slovakia | SK | SVK | Europe |
Croatia | HR | HRV | Europe |
Lithuania | LT | LTU | Europe |
Qatar | QA | QAT | Asia |
Kuwait | KW | KWT | Asia |
Oman | OM | OMN | Asia |
Panama | PA | PAN | America |
Uruguay | UY | URY | America |
Mongolia | MN | MNG | Asia |
Armenia | AM | ARM | Asia |
Georgia | GE | GEO | Asia |
Albania | AL | ALB | Europe |
Iceland | IS | ISL | Europe |
Luxembourg | LU | LUX | Europe |
Slovenia | SI | SVN | Europe |
Latvia | LV | LVA | Europe |
Estonia | EE | EST | Europe |
Cyprus | CY | CYP | Europe |
World | XX | WLD | Global | global; world total
Africa | XO | AFR | Africa |
Asia | XS | ASI | Asia |
Europe | XE | EUR | Europe |
North America | AN | NAM | America | america north
South America | XU | SAM | America | america south; latin america
Oceania | OC | OCE | Oceania | australasia
"""
