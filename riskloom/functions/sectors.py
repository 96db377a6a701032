"""Industry code ranges and their sector, in order of precedence (first match wins)."""

SECTOR_RANGES: list[tuple[int, int, str]] = [
    (2833, 2836, "Health Care"), (3840, 3851, "Health Care"), (8000, 8099, "Health Care"), (5047, 5047, "Health Care"),
    (5912, 5912, "Consumer Staples"), (2000, 2099, "Consumer Staples"), (2100, 2199, "Consumer Staples"),
    (2840, 2844, "Consumer Staples"), (5400, 5499, "Consumer Staples"), (5140, 5149, "Consumer Staples"),
    (700, 799, "Industrials"),
    (1200, 1299, "Energy"), (1300, 1399, "Energy"), (2900, 2999, "Energy"), (4610, 4619, "Energy"),
    (1000, 1099, "Materials"), (1400, 1499, "Materials"), (2400, 2499, "Materials"), (2600, 2699, "Materials"),
    (2800, 2829, "Materials"), (2837, 2899, "Materials"), (3200, 3299, "Materials"), (3300, 3399, "Materials"),
    (3570, 3579, "Information Technology"), (3670, 3679, "Information Technology"), (3661, 3669, "Information Technology"),
    (7370, 7379, "Information Technology"), (3812, 3812, "Information Technology"),
    (4800, 4899, "Communication Services"), (2700, 2799, "Communication Services"), (7300, 7319, "Communication Services"),
    (7800, 7849, "Communication Services"), (3651, 3652, "Communication Services"),
    (4900, 4999, "Utilities"), (6500, 6599, "Real Estate"), (6798, 6798, "Real Estate"),
    (6000, 6199, "Financials"), (6200, 6299, "Financials"), (6300, 6499, "Financials"), (6700, 6799, "Financials"),
    (2300, 2399, "Consumer Discretionary"), (2500, 2599, "Consumer Discretionary"), (3000, 3199, "Consumer Discretionary"),
    (3700, 3716, "Consumer Discretionary"), (3900, 3999, "Consumer Discretionary"), (5200, 5999, "Consumer Discretionary"),
    (5500, 5599, "Consumer Discretionary"), (7000, 7299, "Consumer Discretionary"), (7500, 7599, "Consumer Discretionary"),
    (7900, 7999, "Consumer Discretionary"), (8200, 8299, "Consumer Discretionary"), (8300, 8399, "Consumer Discretionary"),
    (100, 699, "Consumer Staples"),
    (1500, 1799, "Industrials"), (3400, 3569, "Industrials"), (3580, 3659, "Industrials"), (3680, 3699, "Industrials"),
    (3717, 3799, "Industrials"), (3800, 3829, "Industrials"), (4000, 4799, "Industrials"), (5000, 5199, "Industrials"),
    (7320, 7399, "Industrials"), (8700, 8799, "Industrials"),
]
